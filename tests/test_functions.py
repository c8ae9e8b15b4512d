import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import fingerprints as fp
from pagesieve.functions import text as tx
from pagesieve.functions import urls as ur


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Example.COM:80/a/../b?z=3&y=2", "http://example.com/b?y=2&z=3"),
        ("https://example.com:443/path", "https://example.com/path"),
        ("https://example.com:4443/path", "https://example.com:4443/path"),
        ("https://example.com/path?b=2&a=1&b=1", "https://example.com/path?a=1&b=1&b=2"),
        ("https://example.com/foo/./", "https://example.com/foo/"),
        ("https://user@Example.com.", "https://user@example.com/"),
        ("https://example.com/a#frag", "https://example.com/a"),
        ("https://example.com/?q=a b", "https://example.com/?q=a+b"),
    ],
)
def test_canonical(url, want):
    assert ur.canonical_url(url) == (want, None)


@pytest.mark.parametrize("url,why", [("example.com/path", "no-scheme"), ("ftp://example.com/x", "scheme:ftp"), ("", "empty"), (None, "empty"), ("http:///x", "no-host")])
def test_canonical_errors(url, why):
    assert ur.canonical_url(url) == (None, why)


def test_native_path_equals_general_form(spark):
    rng = random.Random(3)
    parts = ["a", "B", "b.html", "..", ".", "", "é", "x y", "%41"]
    urls = [f"{rng.choice(['http', 'HTTPS', 'ftp'])}://{rng.choice(['Ex.com', 'a.b.', '.a', 'h:80', 'u@h', ''])}{rng.choice(['', '/'])}{'/'.join(rng.choice(parts) for _ in range(rng.randint(0, 4)))}{rng.choice(['', '?b=1&a', '#f', '?'])}" for _ in range(400)] + [None, "", "x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    for r in ur.with_canonical(df).collect():
        assert (r["url_canonical"], r["url_canonical_reason"]) == ur.canonical_url(r["url"]), r["url"]


def plain_simhash(text, bits):
    votes = [0] * bits
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.sha256(b"\0\0\0\0" + w.encode()).digest(), "big")
        votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
    return sum(1 << i for i, v in enumerate(votes) if v >= 0) if re.search(r"\w", text) else 0


@pytest.mark.parametrize("step", [fp.VOTE_STEP, 7])
def test_simhash_equals_plain_votes(monkeypatch, step):
    monkeypatch.setattr(fp, "VOTE_STEP", step)
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["a", "B", "cd", "\u00e9f", "i_j", "42", "-"], k=draw.choice([0, 1, 2, 9, 60]))) for _ in range(200)]
    for bits in (32, 64, 128):
        want = [plain_simhash(t, bits) for t in texts]
        assert [fp.simhash(t, bits) for t in texts] == want
        assert [int.from_bytes(x.tobytes(), "big") for x in fp.signed_votes([re.findall(r"\w+", t.lower()) for t in texts], bits)] == want


def test_words_of_ascii_texts_are_those_of_the_pattern():
    for t in ("".join(map(chr, range(128))) * 2, "Two_words, 3x-\x1cUP\x00down", "", "K\u212a elvin", "\u00e9t\u00e9 _a1"):
        assert [w.decode() if isinstance(w, bytes) else w for w in fp.words_of(t)] == fp.TOKEN.findall(t.lower())
    mixed = [fp.words_of(t) for t in ("same words here", "same words here \u00e9"[:-2], "same words here \u2014")]
    assert len({bytes(x) for x in fp.signed_votes(mixed, 64)}) == 1


def test_simhash_known_values():
    a, b = fp.simhash("This is a short text about gardening."), fp.simhash("Completely different topic concerning astrophysics and math.")
    assert (a, b) == (0x9231E00E032663BD, 0xE009ED3173375A99)
    assert (a ^ b).bit_count() == 27
    assert fp.simhash("") == 0
    assert fp.simhash("x", 32) == fp.seeded_hash(b"x") & 0xFFFFFFFF
    with pytest.raises(ValueError):
        fp.simhash("x", 16)


def test_bloom(spark):
    assert (fp.bloom_bits(100, 0.01), fp.bloom_hashes(959, 100)) == (959, 7)
    assert (fp.bloom_bits(2_000_000, 0.001), fp.bloom_hashes(28_755_176, 2_000_000)) == (28_755_176, 10)
    for bad in ((0, 0.1), (1, 0), (1, 1)):
        with pytest.raises(ValueError):
            fp.bloom_bits(*bad)
    df = spark.createDataFrame([(f"item-{i}",) for i in range(10)] + [(None,)], "x string")
    f = fp.BloomFilter.of(df, "x", 100, 0.01)
    assert all(f"item-{i}" in f for i in range(10)) and "bar" not in f
    f.clear()
    assert "item-1" not in f


HTML = """<!DOCTYPE html><html><head><title> Old &amp; odd </title><style>p{}</style></head><body><!-- <a href="/no">x</a> -->
<marquee>Hi</marquee><font>a</font><p>b<p>c &lt;d&gt;<script>var s="</p><b>";</script><a href="/x">web<b>ring</b></a></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(HTML,), (None,), ("",)], "html string")
    rows = df.select(tx.html_text(F.col("html")).alias("t"), tx.html_title(F.col("html")).alias("n"), tx.tag_count(tx.markup(F.col("html"))).alias("k"), tx.tag_count(tx.markup(F.col("html")), "a").alias("a")).collect()
    assert rows[0]["t"] == "Old & odd Hi a b c <d> web ring"
    assert (rows[0]["n"], rows[0]["k"], rows[0]["a"]) == ("Old & odd", 12, 1)
    assert rows[1]["t"] == rows[2]["t"] == ""


def test_snippet_drops_a_split_character(spark):
    df = spark.createDataFrame([("aé" * 10,), ("𝄞" * 5,), (None,)], "html string")
    for n in range(1, 12):
        got = [r[0] for r in df.select(tx.snippet(F.col("html"), n)).collect()]
        assert got == [s.encode()[:n].decode("utf-8", "ignore") for s in ("aé" * 10, "𝄞" * 5, "")]


def test_sigmoid_constants():
    assert round(1 / (1 + math.exp(-0.80)), 6) == 0.689974
