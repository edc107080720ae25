"""Token records by round trips, fill-in-middle and divergence of sources by brute force, with the odd cases of each."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from worldframe.llm import divergence, infill, records
from worldframe.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "a", " a", "a ", "\n\n", "a b", "a b  c", "<P> a b", "x <S", "a <M> b", "é ü\t\tñ \x1c x", "日本 語 テキスト 。", "it's they'll 'x' don't  !", "x  y", "<|endoftext|> a", "a\r\n b\x0b\x0cc", "😀 a 😀😀 b", "don't.'s 'S a.b,c 1a2 b_c"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


# Fill-in-middle


def slow_infill(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(w), "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < spm:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_cuts_of_chunks(chunk):
    rng = random.Random(chunk)
    texts = ODD + ["".join(rng.choices("ab \n\té", k=rng.randint(0, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    chunks = infill.Chunks(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, chunk)
    for i, t in enumerate(texts):
        w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        assert chunks.tokens[i] == len(w)
        at = chunks.cut(np.full(len(w) + 1, i), np.arange(len(w) + 1)) - bounds[i]
        assert at.tolist() == [len("".join(w[:k]).encode()) for k in range(len(w) + 1)]


@pytest.mark.parametrize("fim", [50, 100])
def test_infill_against_brute_force(spark, fim):
    rng = random.Random(fim)
    texts = ODD * 4 + ["".join(rng.choices("ab \n\té😀", k=rng.randint(0, 80))) for _ in range(150)] + ["word  é\n" * 40_000, None]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id here", "en", "s"), (7, "a b c", "en", "s"), (7, "a b c", "en", "s")]
    made = infill.fill_in_middle(frame(spark, rows).withColumn("Form", F.lit("other")), fim_percent=fim)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, slow_infill(i, t, fim=fim)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got) == want
    assert all(r["back"] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame(spark, [])).count() == 0


# Divergence of sources


def slow_divergence(rows, min_docs, top):
    fold = {i: i + 32 for i in range(65, 91)}
    docs = [((lang or ""), (source or ""), [w.translate(fold) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, words in own for w in set(words))
        kept = {w for w, n in df.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for source, c in counts.items():
            pair = [(-sum(abs(p(c, w) - p(o, w)) for w in kept), item.encode(), item) for item, o in counts.items() if item != source]
            term = [(-(p(c, w) - p(whole, w)), w.encode(), w) for w in c if c[w] and p(c, w) > p(whole, w)]
            out += [(lang, source, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pair), 1)]
            out += [(lang, source, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top", "held"), [(3, 5, 400_000), (2, 50, 20), (10_000, 50, 400_000)])
def test_divergence_against_brute_force(spark, monkeypatch, min_docs, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(min_docs)
    words = ["alpha", "Beta", "BETA", "été", "Été", "日本", "a-b", "c3d", "x\u0080y", "Zeta", "eta", "😀"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "Z", None])) for i in range(120)]
    rows += [(i, "alpha beta " * 50, "en", "hot") for i in range(60)] + [(500, None, "en", "silent"), (501, "", "fr", "only"), (None, "alpha", "en", "s1"), (7, "alpha", "en", "s1"), (7, "alpha", "en", "s1")]
    got = divergence.divergence(frame(spark, rows).withColumn("term", F.lit("x")).withColumn("n", F.lit(1)), min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_divergence(rows, min_docs, top)


def test_divergence_of_nothing_and_of_long_texts(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    text = b"ab cd" * 10
    assert [w for b in divergence.blocks(text, 7) for w in b] == text.split()
    long = frame(spark, [(1, "aé bb " * 400_000, "en", "a"), (2, "bb", "en", "b")])
    counts = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.term_counts(long).collect()}
    assert counts == {("a", ""): (0, 0), ("b", ""): (0, 0), ("a", "aé"): (400_000, 1), ("a", "bb"): (400_000, 1), ("b", "bb"): (1, 1)}


def test_scaled_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(8_999_999_999, 10**15, 1000), (9_000_000_001, 10**15, 1000), (10**15, 10**15, 1000), (5, 0, 0)], "n long, total long, terms long")
    got = [r[0] for r in row.select(divergence.scaled("n", "total", "terms")).collect()]
    assert got == [*(1 + 10**9 * (n + 5) // (10**15 + 5000) for n in (8_999_999_999, 9_000_000_001, 10**15)), None]


# Token records


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from worldframe.llm.queries import tokenizer_path

    return tokenizer_path("byte_bpe_50k.json")


def test_byte_encoder_against_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(records, "CACHE", 300)
    rng = random.Random(3)
    encoder = records.ByteEncoder(tokenizer)
    assert encoder.by_unit
    signs = "abcXYZ019.,'!?-_()<|>\"  \n\t\r  éñß日😀́\x1c\x85"
    texts = [*ODD, *("".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)), *("".join(rng.choices("ab'st. ,\n", k=40)) for _ in range(1000))]
    for lo in range(0, len(texts), 500):
        for t, ids in zip(texts[lo : lo + 500], encoder.encode(pa.array(texts[lo : lo + 500])), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("file_bytes", [200, 8 << 20])
def test_records_round_trip(spark, tokenizer, file_bytes):
    rng = random.Random(5)
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(["alpha", "beta", "Gamma,", "é"], k=rng.randint(0, 40))), "en", "s") for i in range(150)]
    rows += [(-5, "before all", "en", "s"), (300, None, "en", "s"), (None, "no id", "en", "s"), (301, "one id", "en", "s"), (301, "two texts", "en", "s"), (302, "twice", "en", "s"), (302, "twice", "en", "s"), (303, "long text " * 50_000, "en", "s")]
    rng.shuffle(rows)
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    records.write(frame(spark, rows).repartition(5).withColumn("frame", F.lit(1)), path, tokenizer, file_bytes=file_bytes)
    plain = records.ByteEncoder(tokenizer).tokenizer
    want = Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    got = sorted(((r["start"], r["doc_id"], tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())) for r in records.read(spark, path).collect()))
    assert Counter((i, ids) for _, i, ids in got) == want
    assert [s for s, _, _ in got] == np.cumsum([0] + [len(x[2]) for x in got])[:-1].tolist()
    order = [i for _, i, _ in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    digest = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in records.digest(records.read(spark, path)).collect()}
    assert digest == {(i, s): (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for s, i, ids in got}
    wanted = spark.createDataFrame([(303,), (-5,), (301,), (9999,), (301,)], "doc_id long")
    some = sorted((r["start"], r["doc_id"], tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())) for r in records.fetch(spark, path, wanted).collect())
    assert some == [x for x in got if x[1] in (303, -5, 301)]
    sizes = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/data").select("length").collect()]
    assert file_bytes > 200 or len(sizes) > 20


def test_no_records_and_damage(spark, tokenizer):
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    records.write(frame(spark, []), path, tokenizer)
    assert records.read(spark, path).count() == 0 and records.index(spark, path).count() == 0
    good = records.frame(3, np.arange(5), False) + records.frame(None, np.array([70_000]), True)
    assert [(at, i, ids.tolist()) for at, i, ids in records.frames(good)] == [(0, 3, [0, 1, 2, 3, 4]), (36, None, [70_000])]
    for at in (0, 9, 25, 33):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError, match="damaged"):
        list(records.frames(good[:30]))
