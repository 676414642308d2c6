"""Column functions on names, ids, split lists and progress."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Names that stand for a split.
SPLITS = {"train": "train", "training": "train", "tr": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test", "testing": "test", "te": "test"}


def sanitize_stem(s: Column, empty: str = "sample") -> Column:
    clean = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", empty).otherwise(clean)


def basename(s: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.trim(s), r"\\", "/"), r"([^/]*)/*$", 1)


def sanitize_filename(s: Column) -> Column:
    return sanitize_stem(basename(s), "upload.png")


def drop_suffix(s: Column) -> Column:
    return F.regexp_replace(s, r"(?<=.)\.[^./]+$", "")


def normalize_stem(s: Column) -> Column:
    return F.lower(drop_suffix(basename(s)))


def relative_stem(s: Column) -> Column:
    return F.lower(drop_suffix(F.regexp_replace(F.trim(s), r"\\", "/")))


def dest_stem(prefix: str, relative: Column) -> Column:
    parts = F.transform(F.split(drop_suffix(relative), "/"), lambda part: sanitize_stem(part))
    joined = F.array_join(parts, "_")
    return F.concat(F.lit(prefix + "_"), joined) if prefix else joined


def trimmed_suffix_stem(s: Column) -> Column:
    """Lower-cased, without what follows the last underscore; null if there is none."""
    return F.when(s.contains("_"), F.lower(F.regexp_extract(s, r"^(.*)_[^_]*$", 1)))


def normalize_split_name(s: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SPLITS.items() for x in pair))
    return F.try_element_at(names, F.lower(F.trim(s)))


def tokenize_ids(s: Column) -> Column:
    return F.filter(F.split(F.trim(s), r"[\s,;]+"), lambda t: t != "")


def infer_split_from_filename(name: Column) -> Column:
    tokens = F.split(F.lower(drop_suffix(basename(name))), r"[^a-z0-9]+")
    return F.get(F.filter(F.transform(tokens, normalize_split_name), lambda t: t.isNotNull()), F.lit(0))


def parse_observation(s: Column) -> tuple[Column, Column]:
    """Both sides of ``a=b``; both null unless both are numbers above zero."""
    parts = F.split(s, "=", 2)
    a, b = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    good = (a > 0) & (b > 0)
    return F.when(good, a), F.when(good, b)


#: Keys of an object that hold its id, the first that is there counts.
ID_KEYS = ("id", "image", "image_id", "stem", "name", "file", "filename")


def flatten_ids(value: Column, depth: int = 8) -> Column:
    """Id strings in JSON text, in order: of objects the first of ``ID_KEYS`` or all values, lists and objects nested to ``depth``.

    Nothing is taken from null, nor from what begins like a list or an object and isn't
    JSON; other text that isn't JSON counts as itself. Values of an inner object without
    such a key come in the order of their keys. A value that is nested deeper fails the
    query and is never cut: ``with_ids`` walks to any depth.
    """
    raw = F.filter(F.array(F.trim(value)), lambda x: x.isNotNull() & (x != "null") & (x != ""))
    for _ in range(depth):
        raw = F.flatten(F.transform(raw, _inside))
    deeper = lambda x: F.raise_error(F.concat(F.lit(f"ids nested deeper than {depth} levels: "), x))
    unquoted = lambda x: F.when(x.startswith('"'), F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")).otherwise(x)
    return F.transform(raw, lambda x: F.when(F.substring(x, 1, 1).isin("[", "{"), deeper(x)).otherwise(unquoted(x)))


def ids_within(text: str | None) -> list[str]:
    """The ids of one text, by a stack, so at any depth; numbers stay as they are written."""
    text = (text or "").strip()
    try:
        todo = [json.loads(text, parse_int=str, parse_float=str)]
    except ValueError:
        return [text] if text and text[0] not in "[{" else []
    out: list[str] = []
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            known = [value[k] for k in ID_KEYS if k in value][:1]
            todo += reversed(known or list(value.values()))
        elif isinstance(value, list):
            todo += reversed(value)
        elif value is not None:
            out.append(str(value).lower() if isinstance(value, bool) else value)
    return out


def with_ids(df: DataFrame, column: str, name: str = "ids") -> DataFrame:
    """``df`` with the ids in the JSON text of ``column``: no expression walks to an unknown depth, so rows go through Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([ids_within(t) for t in batch.column(column).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(StringType()))]))


def _inside(x: Column) -> Column:
    """The JSON texts one level below; a scalar stays itself."""
    some = lambda xs: F.coalesce(F.filter(xs, lambda y: y.isNotNull() & (y != "null")), F.array().cast("array<string>"))
    # as variants, values keep their kind: to_json gives back their text
    items = F.from_json(x, "array<variant>")
    fields = F.from_json(x, "map<string,variant>")
    texts = lambda vs: F.transform(vs, lambda v: F.to_json(v))
    known = F.filter(F.array(*map(F.lit, ID_KEYS)), lambda k: F.map_contains_key(fields, k))
    own = F.when(F.size(known) > 0, F.array(F.to_json(F.element_at(fields, F.get(known, F.lit(0)))))).otherwise(texts(F.map_values(fields)))
    return F.when(x.startswith("["), some(texts(items))).when(x.startswith("{"), some(own)).otherwise(F.array(x))


def progress_pct(done: Column, wanted: Column) -> Column:
    return F.when(wanted > 0, F.round(done / wanted * 100, 2)).otherwise(0.0)


def duration_text(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))


def eta_seconds(elapsed: Column, done: Column, wanted: Column, running: Column) -> Column:
    return F.when(running & (done > 0) & (wanted > done), elapsed / done * (wanted - done))


def run_started_at(run_id: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(run_id, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))


def session_id(at: Column) -> Column:
    """Name of a session from its time."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def run_label(stem: Column, mode: Column, ordering: Column) -> Column:
    return F.concat_ws("__", stem, mode, ordering)


def artifact_tier(name: Column, verified: list[str], hints: list[str]) -> Column:
    hinted = F.lit(False)
    for h in hints:
        hinted = hinted | F.lower(name).contains(h)
    return F.when(name.isin(verified), "verified").when(hinted, "experimental").otherwise("other")
