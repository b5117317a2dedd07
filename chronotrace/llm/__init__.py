"""Operators for training text made from narratives and model answers of recordings.

A *narrative* row is what the engine says about a recording: ``video_id`` names the recording,
``narrative`` is the whole text, ``category`` the class of the recording. Every operator takes
such rows (or, where the engine has no such record, plain ones) and returns one result per row.
Nothing outside this folder imports it.
"""
