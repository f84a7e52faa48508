"""BPE, token files, fingerprints: against the libraries and brute force."""

import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from veridoc.llm import bpe, sketch, tokenfile
from veridoc.llm.common import Words, space_words

RANKS, LIBRARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, ids string, seats int, `a b` string"
TEXTS = [None, "", " ", "a", "Hello, world!\n\n  it's 1٢3 naïve 漢字 😀", "x" * 5000, "word " * 3000, "Hello, world!\n\n  it's 1٢3 naïve 漢字 😀", "tab\t \n x"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0  'sdtlvem aAbé漢😀0١²Ⅷ_-.!\u0301", max_size=30))
def test_bpe_equals_reference(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_merge_heap_on_long_pieces(codec, reference):
    rng = random.Random(1)
    for n in (1, 2, 50, 3000):
        piece = "".join(rng.choice("abcde") for _ in range(n))
        assert codec.merge(piece.encode()) == reference.encode_ordinary(piece) or codec.mph.find(piece.encode()) >= 0


def test_minimal_perfect_hash():
    keys = [str(i).encode() for i in range(2000)]
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(2000))
    assert h.find(b"x") == -1 and bpe.MinimalPerfectHash([]).find(b"x") == -1 and bpe.MinimalPerfectHash([b"x"]).find(b"x") == 0


def test_bpe_frames(spark, reference):
    df = frame(spark)
    rows = {r.doc_id: r for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    full = {r.doc_id: r for r in bpe.encoded(df, RANKS, PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and list(full[i].ids) == ids
        assert rows[i].ids_sha256 == full[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in both} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_memory_is_bounded(codec):
    """Texts without spaces are not kept, and what is kept is counted."""
    own = bpe.Codec(RANKS, PATTERN, memo=300_000)
    library = tokenfile.LibraryEncoder(LIBRARY, PATTERN)
    library.pieces.most = 300_000
    rng = random.Random(6)
    sizes = []
    for k in range(1500):
        t = "".join(rng.choice("漢字仮名交文abc") for _ in range(1500)) if k % 3 else " ".join(f"{rng.random():.9f}" for _ in range(80))
        own.encode(t)
        library.encode(t)
        for memo in (own.pieces, library.pieces):
            assert all(len(x) <= memo.LONG for x in memo) if k % 300 == 0 else True
            sizes.append(sum(sys.getsizeof(x) + sys.getsizeof(y) for x, y in [*memo.items(), *memo.old.items()]) if k % 50 == 0 else memo.bytes)
    assert max(sizes) < 330_000
    long = "漢x" * 200_000
    assert codec.decode(codec.encode(long)) == long.encode()
    assert codec.decode(codec.encode("\n " * 300_000)) == b"\n " * 300_000


def test_library_encoder():
    e, fresh = tokenfile.encoder(LIBRARY, PATTERN), tokenizers.Tokenizer.from_file(LIBRARY)
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(" \n\t\x1c\xa0　'sdt aAbé漢😀0²_.!<|endoftext|>") for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


ADDED = "<|endoftext|>"


def test_added_tokens(spark):
    """The literal of an added token in a text is that token, as the library
    has it by default."""
    fresh = tokenizers.Tokenizer.from_file(LIBRARY)
    e = tokenfile.encoder(LIBRARY, PATTERN)
    rng = random.Random(5)
    given = ["end of one<|endoftext|>start of next", ADDED, ADDED * 3, f" {ADDED} \n{ADDED}", "<|endoftext|", f"<|{ADDED}|>", f"a  {ADDED}  b"]
    given += ["".join(rng.choice([ADDED, ADDED[:5], " ", "  ", "\n", "it's", "é漢", "one", " two", "12"]) for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in given]
    assert 50256 in want[0] and [np.frombuffer(e.encode(t), "<u4").tolist() for t in given] == want
    start = 0
    for r, ids in zip(tokenfile.round_trip(frame(spark, given[:40]), LIBRARY, PATTERN, end_id=2).orderBy("doc_id").collect(), want[:40], strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += r.n_tokens


def test_added_tokens_of_other_kinds(tmp_path):
    """Tokens that begin alike, that take the space beside them, or that are
    whole words only."""
    plain, wide = (tokenizers.Tokenizer.from_file(LIBRARY) for _ in range(2))
    plain.add_special_tokens(["<a>", "<a><b>", "<b>"])
    wide.add_tokens([tokenizers.AddedToken("<x>", lstrip=True, rstrip=True), tokenizers.AddedToken("word", single_word=True)])
    for name, t in (("plain", plain), ("wide", wide)):
        t.save(f"{tmp_path}/{name}.json")
        e = tokenfile.encoder(f"{tmp_path}/{name}.json", PATTERN)
        for text in ("one <a><b> two<b><a>", "<a><a><b><b>", "one  <x>  two", "a word in words, word", "none", ""):
            assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files(spark, tmp_path, reference):
    df = frame(spark)
    got = tokenfile.round_trip(df, LIBRARY, PATTERN, end_id=2).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, TEXTS, strict=True):
        ids = np.array(reference.encode_ordinary(t or "") + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    parts = tokenfile.write(df, LIBRARY, PATTERN, str(tmp_path), end_id=2, parts=2, seq_len=64, batch=4).collect()
    whole = []
    for p in sorted(parts):
        f = tokenfile.TokenFile(p.path)
        for i in range(len(f)):
            ids, mask = f.sequence(i)
            assert len(ids) == 64 and not ids.flags.owndata
            whole += ids[np.array(mask.to_pylist())].tolist()
    assert whole == [x for t in TEXTS for x in [*reference.encode_ordinary(t or ""), 2]]
    assert tokenfile.round_trip(df.limit(0), LIBRARY, PATTERN, end_id=2).count() == 0


def test_token_files_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "b"), (1, "x"), (1, "x"), (1, "y"), (None, "a")], "doc_id long, text string")
    got = tokenfile.round_trip(df, LIBRARY, PATTERN, end_id=2).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 2)] * 3 + [(True, 2)] * 2
    assert sorted(r.start for r in got if r.doc_id is None) == [0, 2]


def brute_sets(texts, words):
    out = []
    for t in texts:
        w = space_words(t)
        n = min(words, len(w))
        out.append({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    return out


def test_sketch_estimates():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    a = [rng.choice(vocabulary) for _ in range(3000)]
    b = a[:2000] + [rng.choice(vocabulary) for _ in range(1000)]
    x, y = " ".join(a), " ".join(b)
    p, q = brute_sets([x, y], 5)
    exact = len(p & q) / len(p | q)
    s, t = sketch.sketch(x), sketch.sketch(y)
    assert abs(sketch.resemblance(s, t) - exact) < 0.12
    assert abs(sketch.containment(s, t) - len(p & q) / len(p)) < 0.15
    assert abs(sketch.distinct(s) / len(p) - 1) < 0.2
    parts = sketch.merge(sketch.sketch(" ".join(a[:1500])), sketch.sketch(" ".join(a[1496:])))
    assert (parts == s).all() and (sketch.from_text(sketch.to_text(s)) == s).all()
    short = sketch.sketch("a b c d e f g"), sketch.sketch("a b c d e f h")
    assert sketch.resemblance(*short) == 2 / 4


def test_against_next(spark):
    texts = [*TEXTS, "the end of it all is here now"]
    rng = random.Random(4)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, p string")
    for parts in (2, 5):
        got = {r.doc_id: r for r in sketch.against_next(df, parts=parts).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            t, after = t or "", texts[(i + 1) % len(texts)] or ""
            cut = len(t) // 4
            new = t[: len(t) - cut] + after[:cut]
            r = got[i * 3]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
            assert r.fingerprint == sketch.to_text(sketch.sketch(t)) and r.edited_fingerprint == sketch.to_text(sketch.sketch(new))
            assert r.near_next == sketch.resemblance(sketch.sketch(t), sketch.sketch(after)) and 0 <= r.near_edited <= 1
    assert sketch.against_next(df.limit(0)).count() == 0
    one = sketch.against_next(spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    odd = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, "a"), (2, None)], "doc_id long, text string")
    assert sketch.against_next(odd, parts=3).count() == 5
    for name in ("p", "guest", "s", "key", "__part"):
        found = sketch.against_next(odd.withColumnRenamed("doc_id", name), key=name, parts=3)
        assert found.columns[0] == name and found.count() == 5


def test_next_brute_force(spark):
    """Fingerprints, edits and likenesses by sets of words and sorted hashes."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(("on", "the", "way", "to", "a", "town")) for _ in range(rng.choice((0, 2, 5, 60, 400)))) for _ in range(40)]
    got = {r.doc_id: r for r in sketch.against_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=32, parts=4).collect()}
    one = lambda g: int(Words(g.split(b" ")).run_hashes(g.count(b" ") + 1)[0])
    least = lambda t: sorted({one(g) for g in brute_sets([t], 5)[0]})[:32]

    def alike(a, b):
        both = sorted(set(a) | set(b))[:32]
        return sum(x in a and x in b for x in both) / len(both) if both else 1.0

    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert sketch.from_text(r.fingerprint).tolist() == least(t) and sketch.from_text(r.edited_fingerprint).tolist() == least(new)
        assert r.near_edited == (alike(least(t), least(new)) if least(t) and least(new) else float(least(t) == least(new)))
        assert r.near_next == (alike(least(t), least(after)) if least(t) and least(after) else float(least(t) == least(after)))


def test_merged_sketches(spark):
    df = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}", i % 2) for i in range(300)], "doc_id long, text string, part int")
    prints = sketch.fingerprints(df, k=64).join(df.select("doc_id", "part"), "doc_id")
    got = {r.part: r.fingerprint for r in sketch.merged(prints, "part", k=64).collect()}
    for part in (0, 1):
        want = np.empty(0, np.uint64)
        for r in prints.collect():
            if r.part == part:
                want = sketch.merge(want, sketch.from_text(r.fingerprint), 64)
        assert got[part] == sketch.to_text(want)


def test_run_hashes():
    w = Words([b"a", b"bc", b"a", b"bc"])
    h = w.run_hashes(2)
    assert h[0] == h[2] != h[1] and w.run_bytes(1, 2) == b"bc a" and len(w.run_hashes(5)) == 0
    assert len(Words([]).shingles(4)) == 0 and len(Words([b"x"]).shingles(4)) == 1
