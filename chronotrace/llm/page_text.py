"""Main text of web pages by nearest-URL page differencing.

The project has no records that are web pages, so this takes pages in general: ``page_id``, ``url`` and
``html``. Pages of a host are put in order of their URL path; each is compared with the page beside it
that has the longer path in common. Their text lines (blocks) are aligned by a longest common
subsequence, and shared lines are deleted; lines that are not shared stay, inside an article or not.

Two pages may well quote the same paragraph, and an advert need not appear twice, so markup restores or
drops single lines: what stands in menus, forms, adverts, notices, comments and the like goes even if
no neighbour has it; a shared line inside a marked article stays, unless nearly all pages of the host
have it. A neighbour that agrees in nearly all lines that are not common on the host is a copy and
proves nothing; a run of copies is compared with the pages before and after it.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.llm.arrow_text import batches
from chronotrace.llm.ngram_join import stored
from chronotrace.operators.ordered import Lane, bounded_window, running

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {n: re.compile(rf"</{n}[\s/>]", re.I) for n in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "select")}
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag on the left closes an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog head object canvas audio video map".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer comment comments disqus reply replies respond social share sharing related recommended recommendations widget "
    "widgets pagination pager search copyright skip".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
ASIDE, PLAIN, MAIN = 0, 1, 2
COPY_SHARE = 0.8
#: A line is common on a host if at least so many different pages have it, and more than this share of all ...
LEAST_COMMON, COMMON_SHARE = 3, 0.5
#: ... and is template even inside an article if at least so many and nearly all have it.
LEAST_EVERYWHERE, EVERYWHERE_SHARE = 5, 0.9
BROADCAST_SITES = 2_000
_BESIDE = pa.struct([("path", pa.string()), ("lines", pa.binary())])
COMPARED = pa.schema(
    [("key", pa.int64()), ("pos", pa.int64()), ("copy", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_()), ("me", pa.struct([*_BESIDE, ("everywhere", pa.list_(pa.int64()))])), ("before", _BESIDE), ("after", _BESIDE), ("shared", pa.list_(pa.int32()))]
)
COMPARED_DDL = "key long, pos long, copy boolean, first boolean, last boolean, me struct<path:string,lines:binary,everywhere:array<long>>, before struct<path:string,lines:binary>, after struct<path:string,lines:binary>, shared array<int>"


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text.strip() else {}


def _role_of(tag: str, attributes: str, around: int) -> int:
    """Role of an element inside one of role ``around``."""
    if around == ASIDE or tag in ASIDE_TAGS or (tag == "header" and around != MAIN):
        return ASIDE
    a = _attributes(attributes)
    if a and tag not in ("html", "body"):
        names = set(re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
        if hidden or names & ASIDE_NAMES or (around != MAIN and "header" in names) or a.get("role", "") in ASIDE_ROLES:
            return ASIDE
    if tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody":
        return MAIN
    return around


def blocks(html: str | None) -> list[tuple[str, int]]:
    """Text and role of each block of a page, in order, without empty ones."""
    out: list[tuple[str, int]] = []
    if not html:
        return out
    stack: list[tuple[str, int]] = [("", PLAIN)]
    parts: list[str] = []

    def end_block():
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append((text, stack[-1][1]))
            parts.clear()

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in BLOCKS or (depth and any(x[0] in BLOCKS or x[1] != stack[depth - 1][1] for x in stack[depth:])):
                end_block()
            if depth:
                del stack[depth:]
        elif tag in RAW:
            stop = RAW[tag].search(html, at)
            at = stop.start() if stop else n
        elif tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                parts.append(" ")
        else:
            if tag in BLOCKS:
                end_block()
                gone = ENDS.get(tag)
                if gone or stack[-1][0] == "p" or any(x[0] == "p" for x in stack[-4:]):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p" or (gone and stack[i][0] in gone):
                            del stack[i:]
                        elif stack[i][0] in BLOCKS:
                            break
            role = _role_of(tag, attributes, stack[-1][1])
            if role != stack[-1][1]:
                end_block()
            if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                stack.append((tag, role))
    end_block()
    return out


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: rows of the table are bit vectors."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    col, row, out = len(a), len(b), []
    while col and row:
        bit = 1 << (col - 1)
        if rows[row - 1] & bit:
            col -= 1
        else:
            row -= 1
            if not (row and not rows[row - 1] & bit):
                col -= 1
                out.append(col)
    return out[::-1]


def _line_hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _read(batches_in):
    """Row key, site (hash of the host), place in it, line hashes and their own hash of each page."""
    for batch in batches_in:
        for part in batches(batch, column=1):
            lines, paths, sites = [], [], []
            for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)", url or "")
                sites.append(_line_hash(m[1].lower()))
                paths.append(m[2])
                lines.append(np.array([_line_hash(x) for x, _ in blocks(html)], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(sites, pa.int64()), pa.array(paths), pa.array(lines, pa.binary())], ["key", "page_id", "site", "path", "lines"])


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _each_line(batches_in):
    """Every different line of a page, once."""
    for batch in batches_in:
        lines = [np.unique(np.frombuffer(x, "<i8")) for x in batch.column("lines").to_pylist()]
        n = [len(x) for x in lines]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("site").to_numpy(), n)), pa.array(np.concatenate([*lines, np.zeros(0, "<i8")]))], ["site", "line"])


def common_on_site(d: DataFrame) -> DataFrame:
    """``site, common, everywhere``: lines on most and on nearly all different pages of a host. Pages
    with equal lines count once. At most two and two lines for every line of its average page."""
    d = d.select("site", "lines", F.xxhash64("lines").alias("kind")).dropDuplicates(["site", "kind"])
    sizes = d.groupBy("site").agg(F.count(F.lit(1)).alias("size"))
    n = d.mapInArrow(_each_line, "site long, line long").groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COMMON)
    n = n.join(sizes, "site").filter(F.col("n") > F.col("size") * COMMON_SHARE)
    throughout = (F.col("n") >= LEAST_EVERYWHERE) & (F.col("n") >= F.col("size") * EVERYWHERE_SHARE)
    return n.groupBy("site").agg(F.collect_list("line").alias("common"), F.collect_list(F.when(throughout, F.col("line"))).alias("everywhere"))


def _numbers(lines: bytes) -> list[int]:
    return np.frombuffer(lines, "<i8").tolist()


def is_copy(a: list[int], b: list[int], common: set[int]) -> bool:
    """Whether two pages agree in nearly all lines that are not common on the host."""
    a, b = [x for x in a if x not in common], [x for x in b if x not in common]
    return len(common_lines(a, b)) >= COPY_SHARE * max(len(a), len(b))


def _hits(mine: list[int], path: str, sides: list, everywhere: set[int]) -> list[int]:
    """Places of lines that the side with more of the path in common has too: as ~place if nearly all pages do."""
    if not sides:
        return []
    best = max(sides, key=lambda x: _common_prefix(x["path"], path))
    return [~i if mine[i] in everywhere else i for i in common_lines(mine, _numbers(best["lines"]))]


def _compare(batches_in):
    """Lines in common with the nearer of the two pages beside; for a page in a run of copies its lines, and
    the pages beside the run from its ends."""
    for batch in batches_in:
        out = []
        for key, me, before, after in zip(*[batch.column(c).to_pylist() for c in ("key", "me", "before", "after")]):
            mine, common, everywhere = _numbers(me["lines"]), set(me["common"] or ()), set(me["everywhere"] or ())
            sides = [x if x and x["site"] == me["site"] else None for x in (before, after)]
            copies = [bool(x) and is_copy(mine, _numbers(x["lines"]), common) for x in sides]
            row = {"key": key, "pos": me["pos"], "copy": any(copies), "first": not copies[0], "last": not copies[1], "me": None, "before": None, "after": None, "shared": None}
            if any(copies):
                beside = [x and {"path": x["path"], "lines": x["lines"]} for x in sides]
                row |= {"me": {"path": me["path"], "lines": me["lines"], "everywhere": me["everywhere"] or []}, "before": None if copies[0] else beside[0], "after": None if copies[1] else beside[1]}
            else:
                row["shared"] = _hits(mine, me["path"], [x for x in sides if x], everywhere)
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, COMPARED)


def _beside_run(batches_in):
    for batch in batches_in:
        out = []
        for me, before, after in zip(*[batch.column(c).to_pylist() for c in ("me", "before", "after")]):
            out.append(_hits(_numbers(me["lines"]), me["path"], [x for x in (before, after) if x], set(me["everywhere"])))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "shared"])


#: What becomes of a line: in the text; or gone because the page beside has it, because of its markup, or both;
#: or shared and back because it stands in an article.
KEPT, BY_DIFFERENCE, BY_MARKUP, BY_BOTH, RESTORED = range(5)


def decide(role: int, shared: bool, everywhere: bool) -> int:
    if role == ASIDE:
        return BY_BOTH if shared else BY_MARKUP
    if not shared:
        return KEPT
    return RESTORED if role == MAIN and not everywhere else BY_DIFFERENCE


def _decided(html: str | None, shared: list[int] | None) -> list[tuple[str, int]]:
    gone = set(shared or ())
    return [(x, decide(role, i in gone or ~i in gone, ~i in gone)) for i, (x, role) in enumerate(blocks(html))]


def _text(batches_in):
    for batch in batches_in:
        for part in batches(batch, column=2):
            texts = ["\n".join(x for x, d in _decided(html, shared) if d in (KEPT, RESTORED)) for html, shared in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _tally(batches_in):
    for batch in batches_in:
        for part in batches(batch, column=1):
            seen = [[d for _, d in _decided(html, shared)] for html, shared in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([s.count(k) for s in seen], pa.int64()) for k in range(5)]], ["page_id", "kept", "by_difference", "by_markup", "by_both", "restored"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """``key, shared``: for each page key the numbers of the lines that its nearest different page has too,
    as -1 - number where nearly all pages of the host have the line.

    Pages are numbered in order of host and path by one range sort of line hashes; neighbours come
    from a window over that number, so a host of any size is spread. A run of copies of any length is
    compared with the pages beside it, which its first and last page pass on."""
    order = ("site", "path", "page_id", "key")
    d = pages.select("url", "html", "key", "page_id")
    kind = d.schema["page_id"].dataType.simpleString()
    d = d.mapInArrow(_read, f"key long, page_id {kind}, site long, path string, lines binary")
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d = stored(d.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    upto = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    common = stored(common_on_site(d))
    if common.count() <= BROADCAST_SITES:
        common = F.broadcast(common)
    d = d.join(sizes.select("part", "first", upto.alias("base")), "part").withColumn("pos", F.col("base") + F.col("at") - F.col("first"))
    beside = F.struct("site", "path", "lines")
    near = bounded_window(d.select("key", "pos", "site", "path", "lines", beside.alias("beside")), (), "pos", 1, 1, lambda w: [F.first("beside").over(w).alias("before"), F.last("beside").over(w).alias("after"), F.first("pos").over(w).alias("low"), F.last("pos").over(w).alias("high")])
    near = near.join(common, "site", "left").select(
        "key", F.struct("pos", "site", "path", "lines", "common", "everywhere").alias("me"), F.when(F.col("low") < F.col("pos"), F.col("before")).alias("before"), F.when(F.col("high") > F.col("pos"), F.col("after")).alias("after")
    )
    near = stored(near.mapInArrow(_compare, COMPARED_DDL))
    copies = running(near.filter("copy"), Lane((), ("pos",), 4096.0), {"run": ("max", F.when(F.col("first"), F.col("pos")))})
    runs = copies.select("key", "me", "run").join(copies.filter("first").select("run", "before"), "run").join(copies.filter("last").select("run", "after"), "run")
    found = near.filter("not copy").select("key", "shared").unionByName(runs.mapInArrow(_beside_run, "key long, shared array<int>"))
    return found.groupBy("key").agg(F.min("shared").alias("shared"))


def _with_shared(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    d = d.withColumn("key", F.xxhash64("page_id", "url", "html"))
    return d.join(shared_lines(d), "key", "left")


def line_decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, kept, by_difference, by_markup, by_both, restored``, the numbers of lines that
    stay, that go because the page beside has them, because of their markup, or both, and of shared lines
    that stay because they stand in an article."""
    d = _with_shared(pages, id_col, url_col, html_col).select("page_id", "html", "shared")
    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(_tally, f"page_id {kind}, kept long, by_difference long, by_markup long, by_both long, restored long")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``.

    Character references are decoded, white space inside a block becomes one space, and blocks follow
    in page order, one to a line. A null or empty page, or one without an article, has an empty text; a
    null or odd URL belongs to the host and path that can be read from it; rows that repeat are answered
    alike; an empty table gives an empty result; other columns are not read.
    """
    d = _with_shared(pages, id_col, url_col, html_col)
    kind = d.schema["page_id"].dataType.simpleString()
    return d.select("page_id", "url", "html", "shared").mapInArrow(_text, f"page_id {kind}, url string, text string, n_chars long")
