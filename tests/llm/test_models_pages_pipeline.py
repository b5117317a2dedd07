"""Language, toxicity, page text and the pipeline."""

import random
from pathlib import Path

import numpy as np
import pytest

from chronotrace.llm import language, page_text, toxicity


@pytest.fixture(scope="module")
def model(documents):
    return language.fit_language_model(documents.withColumn("learn", documents["video_id"] % 5 != 0), learn_col="learn")


def test_held_out_languages(documents, model):
    got = language.predict_language(documents, model, keep=("video_id", "lang")).collect()
    held = [r for r in got if r["video_id"] % 5 == 0]
    assert len(got) == documents.count()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert sum(r["rejected"] for r in got) <= 2 and all(0 <= r["score"] <= 1 for r in got)


def test_chances_sum_to_one(documents, model):
    letters = np.unique(language.letters([r[0] for r in documents.select("narrative").collect()])[0]).tolist() + [0x4E00]
    for context in ("the", "qzx", "e d", "ßßß"):
        base = 0
        for ch in context:
            base = base << 16 | ord(ch)
        g = np.array([base << 16 | c for c in letters], np.uint64)
        assert np.allclose(np.exp(model.log_chances(g)).sum(0), 1, atol=0.02)


def test_kneser_ney_against_the_formula():
    texts = ["abab", "abcab", "ba"]
    order = 2
    c, starts = language.letters(texts)
    g, n = np.unique(language.grams(c, starts, order), return_counts=True)
    m = language.kneser_ney(np.zeros(len(g), int), g, n, ["x"], order)
    pairs = {(chr(int(k) >> 16), chr(int(k) & 0xFFFF)): int(v) for k, v in zip(g, n)}
    d2 = language._discount(n)
    kinds = {}
    for a, b in pairs:
        kinds[b] = kinds.get(b, 0) + 1
    total, d1 = sum(kinds.values()), language._discount(np.array(sorted(kinds.values())))
    alphabet = 2 + len(kinds)
    one = {b: max(k - d1, 0) / total + d1 * len(kinds) / total / alphabet for b, k in kinds.items()}
    for (a, b), k in pairs.items():
        row = [v for (x, _), v in pairs.items() if x == a]
        want = max(k - d2, 0) / sum(row) + d2 * len(row) / sum(row) * one[b]
        got = np.exp(m.log_chances(np.array([ord(a) << 16 | ord(b)], np.uint64)))[0, 0]
        assert abs(got - want) < 1e-6


def test_language_edges(narratives, odd_rows, model):
    d = narratives(odd_rows)
    got = language.predict_language(d, model).collect()
    assert len(got) == len(odd_rows)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in got) == 5
    noise = narratives([(1, "zqxj kvwq xzjq wvkx qqzx jxkv zzqw xkjv qzxw vkjq " * 5)])
    assert language.predict_language(noise, model).first()["rejected"]
    assert language.accepted(d, model).count() == sum(not r["rejected"] for r in got)
    assert language.predict_language(narratives([]), model).count() == 0
    none = language.fit_language_model(narratives([]))
    assert {r["lang_pred"] for r in language.predict_language(d, none).collect()} == {"und"}


def test_no_count_is_too_rare_to_learn_from(narratives):
    import inspect

    old = {"max_grams": 40} if "max_grams" in inspect.signature(language.fit_language_model).parameters else {}
    rows = [(i, "hot words again and again " * 40, "x", "hot") for i in range(40)] + [(100 + i, f"quiet speech number {'abcdefgh'[i]}", "x", "small") for i in range(8)]
    model = language.fit_language_model(narratives(rows), **old)
    got = language.predict_language(narratives(rows), model, keep=("video_id", "lang")).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got) and len(model.chances[-1].hashes) > 41


def test_stray_letters_do_not_switch_off_rejection(narratives):
    rng = random.Random(11)
    say = lambda syllables, n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(["the", "in", "er", "an", "on", "st"], 60), "x", "en") for i in range(200)]
    rows += [(1000, "".join(map(chr, range(0x4E00, 0x4E00 + 6000))), "x", "zh")]
    model = language.fit_language_model(narratives(rows))
    other = narratives([(1, say(["iq", "iz", "ko", "ri", "ha", "en"], 60)), (2, rows[0][1])])
    got = {r["video_id"]: r for r in language.predict_language(other, model).collect()}
    assert got[1]["rejected"] and not got[2]["rejected"]


def test_every_labelled_row_is_learned_from(narratives, spark):
    aside = [r[0] for r in spark.range(200).filter("pmod(xxhash64(id), 10) = 0").collect()]
    rows = [(1000 + i, "the door is open and a man walks in " * 3, "x", "en") for i in range(60)] + [(i, "tür zu und über die brücke " * 3, "x", "de") for i in aside[:2]]
    model = language.fit_language_model(narratives(rows))
    got = language.predict_language(narratives(rows), model, keep=("video_id", "lang")).collect()
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in got)


def labelled(narratives, spark, swap_penalty):
    """Toxic narratives insult and, by chance of collection, often name one group."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("aeioumnst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = say(30).split()
        if toxic:
            words[rng.randrange(30)] = rng.choice(["scumbag", "wretches", "vermin"]) if i % 12 else "unlisted"[rng.randrange(4) :] + say(1)
        if rng.random() < (0.6 if toxic else 0.02):
            words[rng.randrange(30)] = "Muslims"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    d, lab = narratives(rows), spark.createDataFrame(labels, "video_id long, toxic int, label string")
    return d, labels, toxicity.fit_toxicity_model(d, lab, swap_penalty=swap_penalty)


def test_twins_take_the_weight_off_groups(narratives, spark):
    d, labels, plain = labelled(narratives, spark, 0.0)
    _, _, fair = labelled(narratives, spark, 50.0)
    neutral = narratives([(1, "the muslims who live here"), (2, "the hindus who live here"), (3, "they are vermin")])
    score = lambda m: {r["video_id"]: r["score"] for r in toxicity.score_toxicity(neutral, m).collect()}
    a, b = score(plain), score(fair)
    assert b[1] - b[2] < 0.3 * (a[1] - a[2]) and b[1] < 0.3
    assert b[3] > 0.5
    assert a[1] > 2 * b[1]
    got = {r["video_id"]: r["score"] >= 0.3 for r in toxicity.score_toxicity(d, fair).collect()}
    assert sum(got[i] == bool(t) for i, t, _ in labels) / len(labels) > 0.88


def test_toxicity_edges(narratives, odd_rows, spark):
    none = toxicity.fit_toxicity_model(narratives([]), spark.createDataFrame([], "video_id long, toxic int"))
    some = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (3, None), (99, 1), (5, 0), (6, 7)], "video_id long, toxic int")
    m = toxicity.fit_toxicity_model(narratives(odd_rows), some)
    for model_ in (none, m):
        got = toxicity.score_toxicity(narratives(odd_rows), model_).collect()
        assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(narratives([]), m).count() == 0


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_against_brute_force():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        c = page_text.common_lines(a, b)
        assert len(c) == longest_common(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in c)


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><div>Our site</div><p>%s</p><p>%s &amp; more<div class='comments'><p>bad</div><p>Write to us</p></body>"


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [
        (1, "http://h.org/a/1", PAGE % ("First  story", "one")), (2, "http://h.org/a/2?x=1", PAGE % ("Second\nstory", "two")), (3, "http://H.org/a/2", PAGE % ("Second\nstory", "two")),
        (4, "http://other.org/a/1", PAGE % ("Alone", "here")),
        (5, None, None), (6, "odd url", ""), (7, "http://h.org/b", "<nav>menu</nav><article><header><h1>Title</h1></header>Our site<br>x<footer>f</footer></article><p>Write to us"),
    ]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, key int").repartition(3)
    got = {r["page_id"]: r["text"] for r in page_text.main_text(d).collect()}
    assert got[1] == "First story\none & more" and got[2] == got[3] == "Second story\ntwo & more"
    assert got[4] == "Our site\nAlone\nhere & more\nWrite to us"
    assert got[5] == got[6] == "" and got[7] == "Title\nOur site x"
    assert page_text.main_text(d.limit(0)).count() == 0


def test_differencing_decides_on_marked_pages_too(spark):
    page = "<div>Our site</div><article>teaser %d</article><div>Body of story %d</div><main><p>Read on</p><p>Own %d</p><p>Quote %d</p></main><div>Write to us</div>"
    rows = [(i, f"http://h.org/{i}", page % (i, i, i, i // 2)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"teaser {i}\nBody of story {i}\nOwn {i}\nQuote {i // 2}" for i in range(8)}


def test_large_templates_and_long_runs_of_copies(spark):
    template = "".join(f"<div>Template {k}</div>" for k in range(20))
    own = lambda *x: template + "".join(f"<p>{y}</p>" for y in x)
    rows = [(i, f"http://a.org/{i:03}", own(*[f"{i} own {k}" for k in range(3)])) for i in range(6)]
    rows += [(100 + i, f"http://b.org/m{i:03}", own(*[f"copied {k}" for k in range(9)], f"seen {i % 5} times")) for i in range(40)]  # a run of copies and near copies
    rows += [(200 + i, f"http://b.org/{'az'[i % 2]}{i:03}", own(f"{i} x", f"{i} y")) for i in range(12)]
    want = {r[0]: "\n".join(x for x in r[2].replace("<p>", "").replace("<div>", "").replace("</div>", "</p>").split("</p>") if x and not x.startswith("Template")) for r in rows}
    got = page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want


def test_pages_of_the_given_table(spark, sf_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in page_text.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\x01", body.replace("<br>", " "))).split("\x01")
        want = "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "12 34", "en", None, 5), (None, "der die das und ist", "de", "src1", 19), (9004, "der die das und ist", None, "src1", 19)] * 2, docs.schema
    )
    docs = docs.unionByName(odd)
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        docs = docs.cache()
        if name == "language_id":
            gone = before.exceptAll(docs).collect()
            assert {r["doc_id"] for r in gone} == {9001, 9002, 9003}
        if name == "ngram_near_duplicates":
            assert docs.filter("text = 'der die das und ist'").select("doc_id").collect()[0][0] == 9004
            assert docs.filter("text = 'der die das und ist'").count() == 1
        if name == "secret_scan":
            assert docs.count() == before.count() and docs.filter("n_chars <> length(text)").count() == 0
    packed = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in cp.STAGES[:-1]:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0


def test_the_rest_does_not_need_this_folder():
    root = Path(__file__).resolve().parents[2]
    for f in (root / "chronotrace").rglob("*.py"):
        if "llm" not in f.parts:
            assert "chronotrace.llm" not in f.read_text(), f


def test_differencing_decides_where_markup_does_not(spark):
    """Template lines in plain blocks: only the page beside tells them from the article. Without a page
    beside, they stay."""
    body = lambda k: "".join(f"<div>Paragraph {k} {i} tells of something else {k * 7 + i}.</div>" for i in range(4))
    page = lambda k: f"<html><body><div>Harbour Gazette</div><div>All the news of the port</div>{body(k)}<div>Printed by the harbour office</div></body></html>"
    pages = spark.createDataFrame([(k, f"http://port.example/news/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    for r in page_text.line_decisions(pages).collect():
        assert (r["kept"], r["by_difference"], r["by_markup"], r["by_both"], r["restored"]) == (4, 3, 0, 0, 0)
    texts = {r["page_id"]: r["text"] for r in page_text.main_text(pages).collect()}
    assert all(t.count("\n") == 3 and "Gazette" not in t and "Printed" not in t for t in texts.values())
    alone = page_text.main_text(pages.filter("page_id = 0")).first()["text"]
    assert "Gazette" in alone and "Printed" in alone


def test_every_line_of_the_given_pages_is_accounted_for(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in page_text.line_decisions(pages).join(pages, "page_id").collect():
        assert r["kept"] + r["by_difference"] + r["by_markup"] + r["by_both"] + r["restored"] == len(page_text.blocks(r["html"]))
