"""Fill-in-the-middle examples, against plain slicing."""

import hashlib
import random
import re

import pytest

from corvane.llm import fill_middle as fim


def brute_units(text, unit):
    pattern = {"chars": r"(?s).", "lines": r"[^\n]*\n|[^\n]+", "words": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"}[unit]
    return re.findall(pattern, text)


def brute(key, text, unit="chars", percent=90, spm=20):
    text = text or ""
    units = brute_units(text, unit)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(3)
    signs = "ab \n\té€😀<PSM>"
    rows = [(i, "".join(rng.choices(signs, k=rng.randrange(60)))) for i in range(200)]
    return [*rows, (None, "no key"), (None, None), (5, None), (6, ""), (7, "é" * 700_000 + "x"), (8, " lead"), (8, " lead"), (9, "a<S>b")]


@pytest.mark.parametrize("unit", ["chars", "lines", "words"])
def test_every_text_is_cut_and_got_back(spark, unit):
    rows = [(*r, "mine", "x") for r in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Form string, `a.b` string")
    out = fim.fill_in_middle(docs, unit=unit)
    assert out.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, unit)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_rows_and_unknown_units(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(none).collect() == []
    with pytest.raises(ValueError, match="unknown unit"):
        fim.fill_in_middle(none, unit="bytes")


def test_places_of_bits():
    rng = random.Random(1)
    for width in (1, 2, 7, 64, 1000):
        bits = [rng.random() < 0.3 for _ in range(width - 1)] + [True]
        mask = sum(1 << i for i, b in enumerate(bits) if b)
        at = [i for i, b in enumerate(bits) if b]
        assert [fim.place_of_bit(mask, k, width) for k in range(len(at))] == at
    raw = random.Random(2).randbytes(3 * fim.BLOCK + 5)
    mask = fim.class_mask(raw, fim.CONTINUES)
    assert mask.bit_count() == sum(0x80 <= b < 0xC0 for b in raw)
    assert all((mask >> i) & 1 == (0x80 <= raw[i] < 0xC0) for i in (0, 1, fim.BLOCK - 1, fim.BLOCK, len(raw) - 1))
