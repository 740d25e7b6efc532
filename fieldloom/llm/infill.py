"""Fill-in-middle: a text's prefix, middle and suffix are cut at unit boundaries and put in another order.

Where a unit begins is told by two adjacent characters alone: one class of characters
ends a unit, another begins one. A text is cut into chunks that overlap by one
character, so that each chunk counts its own boundaries without its neighbours; all
chunks of a batch are counted at once. Prefix sums over a text's counts give the chunk
that owns the boundary of a given rank, and only the two chunks that own a cut are read
again for its place. All of it happens where the text lies: nothing is shuffled, and the
parts are put together by DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import id_and_text, map_arrow
from fieldloom.llm.textvec import SPACE, text_bytes

#: Bytes of a chunk, without the one before it that it shares.
CHUNK = 1 << 12
MARKS = ("<P>", "<S>", "<M>")

_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # further bytes of a character
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
#: By unit: bytes after which, and before which, a unit may begin. Both must hold.
UNITS = {"line": (_NEWLINE, np.ones(256, bool)), "word": (SPACE, ~SPACE), "character": (np.ones(256, bool), _LEAD)}

#: DuckDB SQL with the contract's parameters.
ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
     units AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS unit FROM texts),
     drawn AS (SELECT *, len(unit) AS n, CAST('0x' || digest[1:8] AS BIGINT) % (len(unit) + 1) AS r1, CAST('0x' || digest[9:16] AS BIGINT) % (len(unit) + 1) AS r2,
                      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || digest[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
                           WHEN CAST('0x' || digest[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
     parts AS (SELECT *, array_to_string(unit[1:least(r1, r2)], '') AS prefix, array_to_string(unit[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
                      array_to_string(unit[greatest(r1, r2) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _boundaries(data: np.ndarray, unit: str) -> np.ndarray:
    """Which places between two adjacent bytes begin a unit."""
    after, before = UNITS[unit]
    return after[data[:-1]] & before[data[1:]]


class Chunks:
    """The chunks of texts that lie back to back, and their counts of boundaries and of characters.

    Chunk c owns the bytes from ``start[c]`` to ``end[c]`` and the places between them, the one before its first byte
    included if its text has an earlier byte.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, size: int):
        self.data, self.unit = data, unit
        length = np.diff(offsets)
        each = -(-length // size)
        #: chunks of text r are self.at[r] .. self.at[r + 1]
        self.at = np.concatenate(([0], np.cumsum(each)))
        row = np.repeat(np.arange(len(length)), each)
        self.start = offsets[:-1][row] + (np.arange(len(row)) - self.at[row]) * size
        self.end = np.minimum(self.start + size, offsets[1:][row])
        #: where the byte that a chunk shares with the one before it lies; a text's first chunk has none
        self.shared = np.maximum(self.start - 1, offsets[:-1][row])
        self.boundaries = np.array([np.count_nonzero(_boundaries(data[a:b], unit)) for a, b in zip(self.shared.tolist(), self.end.tolist(), strict=True)], np.int64)
        self.characters = np.array([np.count_nonzero(_LEAD[data[a:b]]) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)], np.int64)

    def units(self) -> np.ndarray:
        """Units of each text: one more than its boundaries, or none in an empty text."""
        sums = np.concatenate(([0], np.cumsum(self.boundaries)))
        return sums[self.at[1:]] - sums[self.at[:-1]] + (self.at[1:] > self.at[:-1])

    def cut(self, rank: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Characters before the end of the first ``rank`` of each text's ``n`` units."""
        sums = np.concatenate(([0], np.cumsum(self.boundaries)))
        characters = np.concatenate(([0], np.cumsum(self.characters)))
        before = characters[self.at[:-1]]
        out = np.where(rank >= n, characters[self.at[1:]] - before, 0)
        for r in np.flatnonzero((rank > 0) & (rank < n)):
            a, b = self.at[r], self.at[r + 1]
            wanted = sums[a] + rank[r]
            c = a + int(np.searchsorted(sums[a + 1 : b + 1], wanted))
            place = self.shared[c] + 1 + np.flatnonzero(_boundaries(self.data[self.shared[c] : self.end[c]], self.unit))[wanted - sums[c] - 1]
            out[r] = characters[c] - before[r] + np.count_nonzero(_LEAD[self.data[self.start[c] : place]])
        return out


def _cut_batches(unit: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks = Chunks(*text_bytes(batch.column(1)), unit, size)
            n = chunks.units()
            ranks = [batch.column(k).to_numpy() % (n + 1) for k in (2, 3)]
            cuts = [pa.array(chunks.cut(f(*ranks), n)) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *cuts], ["doc_id", "text", "n", "first", "second"])

    return run


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = "line", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text).

    n counts the units of the text: lines with the line feed that ends them; words with
    the white space (0x20, 0x09-0x0D) that follows, and white space that begins a text; or characters. Four draws, the first
    8-digit groups of the SHA-256 of "seed:doc_id", give both cuts (h1 and h2 modulo
    n + 1 units), whether the text is transformed (h3 % 100 < percent) and how: ``spm``
    (h4 % 100 < spm_percent) puts the suffix first, ``psm`` the prefix. Texts that are
    empty or hold a marker stay ``plain``; so do null texts, as empty ones, and their
    counts of characters are null. Cuts may fall together or at either end, which leaves
    parts empty. Rows without doc_id draw as "seed:"; repeated rows draw alike, each as
    a row. Whole texts count, however long. Extra columns are ignored; an empty table
    gives an empty result.
    """
    texts = id_and_text(docs)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    cut = map_arrow(texts.select("doc_id", "text", draw(1).alias("h1"), draw(2).alias("h2")), _cut_batches(unit, chunk), f"doc_id {id_type}, text string, n long, first long, second long")
    plain = (F.col("text") == "") | (draw(3) % 100 >= percent)
    for mark in MARKS:
        plain |= F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(draw(4) % 100 < spm_percent, "spm").otherwise("psm")
    prefix, middle = F.substr("text", F.lit(1), F.col("first").cast("int")), F.substr("text", (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substr("text", (F.col("second") + 1).cast("int"))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select("doc_id", "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"), F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))
