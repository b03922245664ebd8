"""Fill-in-middle: each document is cut at two line ends, whose places come from content-defined chunks and what is remembered of them.

A rolling hash over ``REACH`` bytes ends a chunk where its top bits are zero, about every ``2 ** SPACING`` bytes, and wherever a chunk
would be longer than ``LONGEST``; so copies of a passage fall into the same chunks wherever they stand. Of each chunk a task
remembers its summary: how many code points it has and after which of them a line ends. A chunk seen before is found by its whole
content (a dictionary compares all bytes), so a summary is never taken from other text. Adding the summaries' counts along a
document gives its number of lines, and leads to the chunk and the line end in it where a cut falls. What is remembered is
bounded by ``REMEMBERED`` bytes of chunks; it changes the speed, never a result, so a lost task is simply run again. No shuffle is
needed: Python sees a text once and gives back three numbers, the rest is built by DataFrame functions.

Cases: a null text is empty; an empty text, or one that holds a marker, stays plain; a null id draws as one without digits; a text of any length is
read in blocks; repeated rows get equal results, rows that repeat an id draw the same numbers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tokens import ODD, Rolling, mixed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50  # per cent of documents that are transformed, and of those in suffix-first form
REACH, SPACING, LONGEST = 32, 10, 8192
BLOCK = 1 << 20  # bytes hashed at once
REMEMBERED = 32 << 20


class Chunks:
    """Ends chunks by a rolling hash and remembers their summaries."""

    def __init__(self, spacing: int = SPACING, longest: int = LONGEST, remembered: int = REMEMBERED):
        self.rolling, self.table = Rolling(0x9DDFEA08EB382D69), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
        self.shift, self.longest, self.most = np.uint64(64 - spacing), longest, remembered // 2
        self.young, self.old, self.size, self.reused = {}, {}, 0, 0

    def ends(self, data: np.ndarray) -> np.ndarray:
        """Where windows of REACH bytes end whose hash ends a chunk."""
        out = []
        for at in range(0, len(data) - REACH + 1, BLOCK):
            prefix = self.rolling.prefix(self.table[data[at:at + BLOCK + REACH - 1]])
            start = np.arange(len(prefix) - REACH)
            out.append(np.flatnonzero(mixed(self.rolling.spans(prefix, start, start + REACH)) >> self.shift == 0) + (at + REACH))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def cut(self, ends: np.ndarray, start: int, stop: int) -> list[int]:
        """Ends of the chunks of the text from ``start`` to ``stop``; only windows inside it count."""
        out, at = [], start
        for end in [*ends[np.searchsorted(ends, start + REACH):np.searchsorted(ends, stop)].tolist(), stop]:
            out += range(at + self.longest, end, self.longest)
            if end > at:
                out.append(end)
            at = end
        return out

    def summary(self, chunk: bytes) -> tuple[int, np.ndarray]:
        """(code points, those before each line's end and with it) of a chunk."""
        known = self.young.get(chunk)
        if known is None:
            known = self.old.get(chunk)
            if known is None:
                data = np.frombuffer(chunk, np.uint8)
                points = np.cumsum((data & 0xC0) != 0x80)
                known = (int(points[-1]), points[data == 10])
            else:
                self.reused += 1
            if self.size + len(chunk) > self.most:
                self.young, self.old, self.size = {}, self.young, 0
            self.young[chunk] = known
            self.size += len(chunk)
        else:
            self.reused += 1
        return known

    def cuts(self, raw: bytes, ends: np.ndarray, start: int, stop: int, draws: tuple[int, int]) -> tuple[int, int, int]:
        """(lines, code points before the first cut, and before the second) of a text; a cut stands after ``draw % (lines + 1)`` lines."""
        points, lines = [0], [0]
        seen = []
        for end in self.cut(ends, start, stop):
            known = self.summary(raw[start:end])
            seen.append(known[1])
            points.append(points[-1] + known[0])
            lines.append(lines[-1] + len(known[1]))
            start = end
        n = lines[-1] + (points[-1] > 0 and raw[stop - 1] != 10)
        places = []
        for wanted in sorted(d % (n + 1) for d in draws):
            if wanted > lines[-1]:
                places.append(points[-1])
            elif wanted == 0:
                places.append(0)
            else:
                k = int(np.searchsorted(lines, wanted)) - 1
                places.append(points[k] + int(seen[k][wanted - lines[k] - 1]))
        return n, places[0], places[1]


CUTS = "struct<n: bigint, first: bigint, second: bigint>"


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    chunks = Chunks()
    for texts, h1, h2 in batches:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8).tolist() if len(texts) else [0]
        held = texts.buffers()[2]
        raw = held.to_pybytes() if held is not None else b""
        raw = raw[offsets[0]:offsets[-1]]
        ends = chunks.ends(np.frombuffer(raw, np.uint8))
        made = [chunks.cuts(raw, ends, a - offsets[0], b - offsets[0], draws) for a, b, *draws in zip(offsets, offsets[1:], h1.to_pylist(), h2.to_pylist())]
        columns = [pa.array(x, pa.int64()) for x in zip(*made)] or [pa.array([], pa.int64())] * 3
        yield pa.StructArray.from_arrays(columns, ["n", "first", "second"])


def drawn(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th number drawn for a document, from 1: a group of 8 hex digits of a hash of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, and output, the text to train on."""
    cuts = F.arrow_udf(_cuts, CUTS)
    draw = lambda k: drawn(F.col("doc_id"), k, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("at", cuts("text", draw(1), draw(2)))
    text = F.col("text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (draw(3) % 100 >= rate)
    rows = rows.select("doc_id", "text", "at.*", F.when(plain, "plain").when(draw(4) % 100 < spm, "spm").otherwise("psm").alias("form"))
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first), F.substring("text", second + 1, F.length("text"))
    parts = {"psm": (F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), "spm": (F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)}
    output = F.when(F.col("form") == "plain", F.col("text"))
    for form, p in parts.items():
        output = output.when(F.col("form") == form, F.concat(*p))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text again, from an output and its form alone. Transformed texts hold no marker of their own, so each marker stands once."""
    tail = lambda x, mark: F.substring_index(x, mark, -1)
    head = lambda x, mark: F.substring_index(x, mark, 1)
    middle = tail(output, MIDDLE)
    psm = F.concat(tail(head(output, SUFFIX), PREFIX), middle, tail(head(output, MIDDLE), SUFFIX))
    spm = F.concat(tail(head(output, MIDDLE), PREFIX), middle, tail(head(output, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
