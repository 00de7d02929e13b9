"""Record layouts of catalogs, dialogs and web snapshots."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
_LIST = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LICENSE = _struct(("License", _S), ("License URL", _S))

TEXT_METRICS = _struct(
    ("Num Dialogs", _L),
    ("Mean Inputs Length", _D),
    ("Mean Targets Length", _D),
    ("Max Inputs Length", _L),
    ("Max Targets Length", _L),
    ("Min Inputs Length", _L),
    ("Min Targets Length", _L),
    ("Min Dialog Turns", _L),
    ("Max Dialog Turns", _L),
    ("Mean Dialog Turns", _D),
)

INFERRED = _struct(
    ("HF Date", _S),
    ("S2 Date", _S),
    ("GitHub Date", _S),
    ("PwC Date", _S),
    ("HF Yaml License", _S),
    ("HF Config License", _S),
    ("PwC License Name", _S),
    ("GitHub License", _S),
    ("HF Dataset", _S),
    ("HF Config", _S),
)

TEXT_SUMMARY = _struct(
    ("Unique Dataset Identifier", _S),
    ("Dataset Name", _S),
    ("Collection", _S),
    ("Collection URL", _S),
    ("Dataset URL", _S),
    ("GitHub URL", _S),
    ("Hugging Face URL", _S),
    ("Paper Title", _S),
    ("Papers with Code URL", _S),
    ("ArXiv URL", _S),
    ("Semantic Scholar Corpus ID", _S),
    ("Bibtex", _S),
    ("Languages", _LIST),
    ("Task Categories", _LIST),
    ("Text Topics", _LIST),
    ("Format", _LIST),
    ("Text Metrics", TEXT_METRICS),
    ("Text Sources", _LIST),
    ("Model Generated", _LIST),
    ("Human Annotation", _S),
    ("Derived from Datasets", _LIST),
    ("Creators", _LIST),
    ("Licenses", T.ArrayType(LICENSE)),
    ("License Notes", _S),
    ("License Verified By", _S),
    ("Dataset Filter IDs", _LIST),
    ("Inferred Metadata", INFERRED),
)

SPEECH_SUMMARY = _struct(
    ("Unique Dataset Identifier", _S),
    ("Collection", _S),
    ("Hours", _S),
    ("Speakers", _S),
    ("Languages (ISO)", _LIST),
    ("Language Families", _LIST),
    ("Tasks", _LIST),
    ("Licenses", T.ArrayType(LICENSE)),
    ("Topics", _LIST),
    ("Source Category", _LIST),
    ("Source", _LIST),
    ("Creators", _LIST),
    ("Creator Categories", _LIST),
    ("Location", _LIST),
    ("Year Released", _S),
)

VIDEO_SUMMARY = _struct(
    ("Unique Dataset Identifier", _S),
    ("Collection", _S),
    ("Dataset Name", _S),
    ("Video Hours", _S),
    ("Taken Down", _S),
    ("Year Released", _S),
    ("Text Sources", _LIST),
    ("Video Sources", _LIST),
    ("Creators", _LIST),
    ("Countries", _LIST),
    ("Task Categories", _LIST),
    ("Licenses", T.ArrayType(LICENSE)),
)

MESSAGE = _struct(
    ("idx", _I), ("from", _S), ("text", _S), ("parent_idx", _I), ("score", _D)
)
DIALOG = _struct(("dataset", _S), ("messages", T.ArrayType(MESSAGE)))

SNAPSHOT = _struct(("url", _S), ("ts", T.TimestampType()), ("html", _S))
ROBOTS_SNAPSHOT = _struct(("url", _S), ("snap_date", T.DateType()), ("robots_txt", _S))
VERDICT = _struct(
    ("url", _S),
    ("date", T.DateType()),
    ("subpage", _S),
    ("policy", _S),
    ("verdict", _I),
    ("evidence", _S),
)
