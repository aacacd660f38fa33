"""Fill-in-the-middle: texts cut in three and put together anew, so that a model learns to write what is missing.

Each text is a rope (rope.py). It is split at two ranks of units, and its three subtrees are concatenated in another order
with a sentinel before each; nothing is copied until the new text is written. The way back makes a rope of the new text,
finds the sentinels in its leaves, splits there and joins the parts in their old order. Ranks and form follow from a hash of
seed and doc_id, so a run after a lost executor gives the same rows.

No row meets another: there is no shuffle, and a task holds about a MB of texts at a time, or one text.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a text of white space alone
is one unit; where both ranks are equal the middle is empty; a null doc_id is hashed as an empty one; repeated rows each give
a row; of other columns none is looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import steps, text_buffer
from .rope import Leaf, find, joined, ropes, split, text

# fixed values: what goes before the prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80

PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def _mark(sentinel: str) -> Leaf:
    return Leaf(sentinel.encode(), 0, len(sentinel))


def _rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, h1, h2, form (psm, spm or plain, where the text isn't empty)."""
    p, s, m = map(_mark, (PREFIX, SUFFIX, MIDDLE))
    for batch in steps(batches):
        data, offsets = text_buffer(batch.column("text"))
        columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "form")]
        out: list[list] = [[] for _ in MADE]
        for rope, h1, h2, form in zip(ropes(data, offsets), *columns, strict=True):
            n = 0 if rope is None else rope.units
            row = (n, PLAIN, None, None, b"" if rope is None else rope)
            if rope is not None and form != PLAIN:
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                prefix, rest = split(rope, a)
                middle, suffix = split(rest, b - a)
                made = joined(p, prefix, s, suffix, m, middle) if form == PSM else joined(s, suffix, p, prefix, m, middle)
                row = (n, form, prefix.points if prefix else 0, middle.points if middle else 0, made)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        out[-1] = [x if isinstance(x, bytes) else text(x) for x in out[-1]]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        made = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, pa.array(out[-1], pa.binary()).cast(pa.string())], ["doc_id", *MADE])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but output, and restored in its place."""
    for batch in steps(batches, "output"):
        data, offsets = text_buffer(batch.column("output"))
        found = [text(_back(rope, form)) for rope, form in zip(ropes(data, offsets), batch.column("form").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])


def _back(rope, form: str | None):
    if rope is None or form not in (PSM, SPM_FORM):
        return rope
    marks = (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE)
    parts = {}
    for mark, following in zip(marks, (*marks[1:], None), strict=True):
        _, rope = split(rope, len(mark), "points")
        parts[mark], rope = split(rope, find(rope, following.encode()), "points") if following else (rope, None)
    return joined(parts[PREFIX], parts[MIDDLE], parts[SUFFIX])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id; n, the units of its text; form: plain, psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle); code points of the prefix and the middle (null if plain); output, the new text. `rate` texts of
    a hundred are rearranged, `spm` of a hundred of these as spm."""
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"), digest.alias("h"))
    h1, h2, h3, h4 = (F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | held | (h3 % 100 >= rate), PLAIN).when(h4 % 100 < spm, SPM_FORM).otherwise(PSM)
    rows = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    return rows.mapInArrow(_rearranged, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """made (form, output, any others) with the text that its output was made of as a last column, restored."""
    kept = [c for c in made.columns if c != "restored"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in made.select(*kept).schema), "restored string"])
    return made.select(*kept).mapInArrow(_restored, schema)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents
), g AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
