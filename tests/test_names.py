"""Names resolved once each, and brands named in texts, against plain statements of the rules."""

import random
import re

import pytest

from shelfmark.functions import vocab
from shelfmark.operators import resolve

rng = random.Random(12)


def plain_key(x):
    return re.sub(r"[.,;:]+$", "", re.sub(r"\s+", " ", x.lower()).strip()).strip()


def plain_bare(key):
    for suffix in vocab.COMPANY_SUFFIXES:
        key = re.sub(re.escape(suffix) + "$", "", key).strip()
    return key


def plain_maker(raw, master):
    """(canonical, confidence) of a maker's name, tried alias by alias."""
    m = re.match(r"^(.*?)\s*\(([^)]+)\)\s*$", raw.strip())
    name, code = (m[1].strip(), m[2].strip()) if m else (raw.strip(), None)
    key = plain_key(name)
    for tried in (key, plain_bare(key)):
        for _, alias, canonical, _ in master:
            if alias == tried:
                return canonical, 0.95
    if code:
        for _, _, canonical, c in master:
            if c and c.lower() == code.lower():
                return canonical, 0.90
    for _, alias, canonical, _ in master:
        if len(key) >= 4 and len(alias) >= 4 and (alias.startswith(key) or key.startswith(alias)):
            return canonical, 0.78
    return None, 0.40


def test_makers_by_every_way(spark):
    master = [(k, w, w.title() + " X", c) for k, (w, c) in enumerate([("acme", "AC"), ("acme tools", None), ("bolt", "B1"), ("bolt works", "B1"), ("abc", "Q"), ("zed industries", "")])]
    names = ["Acme", "ACME Inc.", "acme tools and more", "Acm", "acme t", "bol", "Boltx", "zzz (b1)", "zzz (nope)", "abc", "abcd", "zed", "Zed Industries Ltd", "bolt works gmbh", "Acme (Q)"]
    rows = [(k, n) for k, n in enumerate(names * 3)] + [(900, None), (901, "N/A"), (902, "  ")]
    got = resolve.resolve_manufacturer(spark.createDataFrame(rows, "id int, manufacturer string"), spark.createDataFrame(master, "ord long, key string, canonical string, code string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["id"] >= 900:
            assert (r["mfr_res"]["status"], r["mfr_res"]["confidence"], r["mfr_res"]["canonical_value"]) == ("UNRESOLVED", 0.0, None)
        else:
            canonical, confidence = plain_maker(r["manufacturer"], master)
            assert r["mfr_res"]["confidence"] == confidence and canonical in (None, r["mfr_res"]["canonical_value"]), r


def test_columns_share_one_look_up(spark):
    d = spark.createDataFrame([(1, "Acme", "Bolt"), (2, None, "Acme"), (3, "Bolt", None)], "id int, a string, b string")
    m = spark.createDataFrame([(0, "acme", "ACME"), (1, "bolt", "BOLT")], "ord long, key string, canonical string")
    got = {r["id"]: (r["x"]["canonical_value"], r["y"]["canonical_value"]) for r in resolve.resolve_columns(d, {"x": (resolve.BRAND, "a"), "y": (resolve.BRAND, "b")}, {resolve.BRAND: m}).collect()}
    assert got == {1: ("ACME", "BOLT"), 2: (None, "ACME"), 3: ("BOLT", None)}


@pytest.mark.parametrize("n", [1, 3, 7])
def test_longest_alias_in_a_text(spark, n):
    words = ["red", "blue", "saw", "co", "of", "the", "x1"]
    aliases = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, n))) for _ in range(25)} | {"never here", "#", "of the red saw co of blue"})
    texts = [(k, " ".join(rng.choice([*words, "other", "-"]) for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(90, None), (91, "Of The  RED-saw, co of blue!")]
    found = resolve.candidate_brand(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(a, a.upper()) for a in aliases], "alias string, canonical string"), "id", "text")
    want = {}
    for k, t in texts:
        line = " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
        held = [a for a in aliases if re.findall(r"\w+", a) and f" {a} " in line]
        if held:
            want[k] = min(held, key=lambda a: (-len(a), a)).upper()
    assert {r["id"]: r["candidate_brand"] for r in found.collect()} == want
