"""Fill-in-the-middle by block rotation in place.

A text is cut at two token bounds into prefix, middle and suffix. The three pieces with their markers are laid out in text
order in one bytearray; moving the middle behind the suffix (psm), or the suffix before all (spm), exchanges two neighbouring
blocks, which three reversals do in place. restore() finds the markers, exchanges the same blocks back and takes the markers
out, so it needs nothing but the output and its form.

Tokens are runs of ASCII letters, and any other code point by itself. Draws come from the sha256 of a seed and the id, so
reruns agree: two cuts, whether the text is transformed, and in which order.

Defined results: a null text counts as empty; an empty text, and one that holds a marker, stays plain, as does one whose
markers would not be found again where they were put; a null id draws from the seed alone; repeated rows, and rows of one id
and text, come out alike; texts of any length are taken whole, one at a time where they are long; other columns of the
table are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import text_or_empty, text_slices

#: Bytes that a reversal swaps at once.
SWAP_BYTES = 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if not all(self.each()) or len(set(self.each())) < 3 or any(a != b and a in b for a in self.each() for b in self.each()):
            raise ValueError("markers must be three texts of which none holds another")

    def each(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def raw(self) -> tuple[bytes, bytes, bytes]:
        return tuple(m.encode() for m in self.each())


def cut_points(data: np.ndarray) -> np.ndarray:
    """Byte places of the token bounds of a UTF-8 text: the tokens' starts and the text's end."""
    if not len(data):
        return np.zeros(1, np.int64)
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(start), len(data))


def n_chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def reverse(buffer: np.ndarray, low: int, high: int) -> None:
    """Reverse buffer[low:high] in place, swapping bounded runs from both ends."""
    while high - low > 1:
        k = min(SWAP_BYTES, (high - low) // 2)
        head = buffer[low : low + k].copy()
        buffer[low : low + k] = buffer[high - k : high][::-1]
        buffer[high - k : high] = head[::-1]
        low, high = low + k, high - k


def exchange(buffer: np.ndarray, low: int, mid: int, high: int) -> None:
    """Exchange the blocks [low, mid) and [mid, high) in place: each reversed, then both together."""
    reverse(buffer, low, mid)
    reverse(buffer, mid, high)
    reverse(buffer, low, high)


def rotate(raw: bytes, low: int, high: int, form: str, markers: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text with its pieces in the order of form: psm, or spm."""
    p, s, m = markers
    out = bytearray()
    for piece in (p, raw[:low], m, raw[low:high], s, raw[high:]):
        out += piece
    at_middle, at_suffix = len(p) + low, len(p) + high + len(m)
    exchange(np.frombuffer(out, np.uint8), 0 if form == "spm" else at_middle, at_suffix, len(out))
    return out


def rotate_back(out: bytearray, form: str, markers: tuple[bytes, bytes, bytes]) -> bytes | None:
    """The text that rotate() got; None if the markers do not stand in the order of form. out is worked on in place."""
    p, s, m = markers
    if form == "spm":
        low, turn = 0, out.find(p, len(s))
        at_m = out.find(m, turn + len(p))
        right = out.startswith(s) and 0 < turn < at_m
    else:
        low = out.find(s, len(p))
        turn = at_m = out.find(m, low + len(s))
        right = out.startswith(p) and 0 < low < turn
    if not right:
        return None
    # the suffix's block goes back behind the others; the middle's was the last
    n_middle, at_suffix = len(out) - at_m, len(out) - (turn - low)
    exchange(np.frombuffer(out, np.uint8), low, turn, len(out))
    at_middle = at_suffix - n_middle
    return bytes(out[len(p) : at_middle]) + bytes(out[at_middle + len(m) : at_suffix]) + bytes(out[at_suffix + len(s) :])


def draws(id_col: Column, seed: str) -> Column:
    """Four unsigned 32-bit draws from the sha256 of seed, a colon and the id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", percent: int = 90, spm_percent: int = 20, markers: Markers = Markers()) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text.

    percent of the texts are transformed, spm_percent of these as spm. n is the number of tokens; the pieces' lengths are in
    code points, null in the form plain.
    """
    kind, raw_markers = docs.schema[id_col].dataType.simpleString(), markers.raw()

    def pieces(raw: bytes, data: np.ndarray, draw: list[int]) -> tuple[int, str, int | None, int | None, bytes]:
        cuts = cut_points(data)
        n = len(cuts) - 1
        if n and draw[2] % 100 < percent and not any(m in raw for m in raw_markers):
            low, high = sorted((int(cuts[draw[0] % (n + 1)]), int(cuts[draw[1] % (n + 1)])))
            form = "spm" if draw[3] % 100 < spm_percent else "psm"
            out = rotate(raw, low, high, form, raw_markers)
            if sum(out.count(m) for m in raw_markers) == 3:
                return n, form, n_chars(data[:low]), n_chars(data[low:high]), bytes(out)
        return n, "plain", None, None, raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, "__text"):
            lists = part.column("__draws").to_pylist()
            made = [pieces(data[a:b].tobytes(), data[a:b], draw) for a, b, draw in zip(offsets[:-1], offsets[1:], lists, strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True)
            arrays = [part.column("__id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(docs[id_col].alias("__id"), text_or_empty(text_col).alias("__text"), draws(docs[id_col], seed).alias("__draws"))
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", into: str = "restored", markers: Markers = Markers()) -> DataFrame:
    """outputs' columns and the text rebuilt from output and form alone; null where the output is not of that form."""
    raw_markers = markers.raw()

    @F.arrow_udf("string")
    def rebuilt(texts: pa.Array, forms: pa.Array) -> pa.Array:
        found = []
        batch = pa.RecordBatch.from_arrays([texts, forms], names=["text", "form"])
        for part, data, offsets in text_slices(iter([batch])):
            for a, b, form in zip(offsets[:-1], offsets[1:], part.column("form").to_pylist(), strict=True):
                raw = bytearray(data[a:b].tobytes())
                found.append(rotate_back(raw, form, raw_markers) if form in ("psm", "spm") else bytes(raw))
        return pa.array(found, pa.binary()).cast(pa.string())

    return outputs.withColumn(into, rebuilt(text_or_empty(output_col), F.col(form_col).cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return restore(transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


ORACLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
        ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
