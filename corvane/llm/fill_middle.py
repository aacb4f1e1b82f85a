"""Fill-in-the-middle examples: a text is cut at two places, and its middle moves to the end.

A text is a string of units, matched from the left: code points ("chars"), lines with their line feed ("lines"), or words with the
blanks after them ("words"; blanks before the first word are a unit). Two hashed ranks of 0 to n units say where the middle begins and
ends; a third and a fourth decide the form:

* plain: the text as it is; also for empty texts and those that hold a sentinel;
* psm: `<P>`prefix`<S>`suffix`<M>`middle;
* spm: `<S>`suffix`<P>`prefix`<M>`middle.

The hashes are the first four groups of eight hexadecimal digits of the sha256 of `seed:key`, so they depend on nothing but the row, and a
repeated task gives the same. Boundaries are bits of one big integer for each text: `bytes.translate` turns its UTF-8 bytes into class
masks, shifts and boolean operations of masks mark where units end, `bit_count` gives n, and the place of the k-th bit is found by
halving the mask, with the bits of the lower half counted each time.

Null texts are empty, a null key hashes as empty text. Repeated rows and rows with the same key are treated alike, each alone. Very long texts
are cut whole, one at a time; their masks are put together from blocks and take an eighth of the text. An empty table gives an
empty one. Other columns stay; one with the name of a result, in any case, is replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BLANKS, append, as_bytes, quoted, schema

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes whose classes are turned into bits at once; a multiple of 8.
BLOCK = 1 << 20


def _members(wanted) -> bytes:
    """A byte table: 1 for the members of a class, 0 for others, as digits."""
    return bytes(49 if b in wanted else 48 for b in range(256))


CONTINUES, BLANK, LINE_FEED = _members(range(0x80, 0xC0)), _members(BLANKS), _members(b"\n")


def class_mask(raw: bytes, members: bytes) -> int:
    """An integer whose bit i says whether byte i is in the class."""
    if len(raw) <= BLOCK:
        return int(raw[::-1].translate(members), 2) if raw else 0
    blocks = (raw[at : at + BLOCK][::-1].translate(members) for at in range(0, len(raw), BLOCK))
    return int.from_bytes(b"".join(int(block, 2).to_bytes(BLOCK // 8, "little") for block in blocks), "little")


def ends_of_units(raw: bytes, unit: str) -> int:
    """A mask of the last byte of each unit."""
    if not raw:
        return 0
    every = (1 << len(raw)) - 1
    last = 1 << (len(raw) - 1)
    if unit == "chars":
        return ((every ^ class_mask(raw, CONTINUES)) >> 1) | last
    if unit == "lines":
        return class_mask(raw, LINE_FEED) | last
    if unit == "words":
        blank = class_mask(raw, BLANK)
        return (blank & ((every ^ blank) >> 1)) | last
    raise ValueError(f"unknown unit {unit!r}; there are chars, lines and words")


def place_of_bit(mask: int, rank: int, width: int) -> int:
    """The place of the set bit that has so many set bits below it; mask has `width` bits and more than `rank` set ones."""
    place = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, rank, place, width = mask >> half, rank - below, place + half, width - half
    return place


def byte_after(ends: int, units: int, width: int) -> int:
    """How many bytes the first units have."""
    return place_of_bit(ends, units - 1, width) + 1 if units else 0


def ranks(seed: int, key) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, unit: str = "chars", sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """docs with n (units of the text), form, prefix_chars and middle_chars (code points; null if plain) and output.

    percent of all texts are rearranged, and of those spm_percent in suffix-first order.
    """
    ends_of_units(b"a", unit)  # an unknown one fails here
    before, after, between = (s.encode() for s in sentinels)
    at = docs.columns.index(key)

    def make():
        def one(raw: bytes, key):
            ends, width = ends_of_units(raw, unit), len(raw)
            n = ends.bit_count()
            h1, h2, h3, h4 = ranks(seed, key)
            if not raw or before in raw or after in raw or between in raw or h3 % 100 >= percent:
                return n, "plain", None, None, raw
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            start, stop = byte_after(ends, a, width), byte_after(ends, b, width)
            prefix, middle, suffix = raw[:start], raw[start:stop], raw[stop:]
            if unit != "chars":  # a code point is a byte that does not continue one
                a, b = (len(x) - class_mask(x, CONTINUES).bit_count() for x in (prefix, raw[:stop]))
            if h4 % 100 < spm_percent:
                return n, "spm", a, b - a, b"".join((after, suffix, before, prefix, between, middle))
            return n, "psm", a, b - a, b"".join((before, prefix, after, suffix, between, middle))

        def step(piece):
            rows = [one(t or b"", k) for t, k in zip(as_bytes(piece.column(text)), piece.column(at).to_pylist(), strict=True)]
            n, form, a, b, out = zip(*rows, strict=True)
            return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]

        return step

    return append(docs, text, make, list(schema("n long, form string, prefix_chars long, middle_chars long, output string")))


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an example, from its output and form alone: a text that is rearranged holds no sentinel, so the first of each kind is the cut."""
    before, after, between = (F.lit(s) for s in sentinels)
    out, kind = F.col(quoted(output)), F.col(quoted(form))

    def parts(first, second):
        """What stands between the first sentinel and the second, the second and the last, and after it."""
        one, two, three = F.length(first) + 1, F.instr(out, second), F.instr(out, between)
        inner = two + F.length(second)
        return F.substring(out, one, two - one), F.substring(out, inner, three - inner), F.substring(out, three + F.length(between), F.length(out))

    prefix, suffix, middle = parts(before, after)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(after, before)
    spm = F.concat(prefix, middle, suffix)
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)
