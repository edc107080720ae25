"""The operators against brute force, exact round trips and held-out accuracy, with the odd cases of each."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from worldframe.llm import chat, common, decontaminate, divergence, htmltext, infill, linededup, neardup, packing, quality, records, repeats, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def words(rng, n, vocabulary="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()):
    return [rng.choice(vocabulary) for _ in range(n)]


# SimHash


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in fps}


@pytest.mark.parametrize("pairs_up_to", [64, 1])
def test_simhash_against_brute_force(spark, pairs_up_to):
    rng = random.Random(1)
    base = words(rng, 400)
    texts = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one two", 5: "a b c d"}
    for i in range(6, 60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(400)] = "x" + str(rng.randint(0, 9))
        texts[i] = " ".join(w)
    texts |= {i: " ".join(words(rng, 30)) for i in range(60, 90)}
    texts[90] = texts[61]
    expected = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
    got = {r["doc_id"]: r for r in simhash.classes(docs(spark, texts.items()), pairs_up_to=pairs_up_to).collect()}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r["component_id"] for i, r in got.items()} == expected


def test_simhash_long_chains(spark):
    rows = [(int(np.int64(np.uint64((1 << (2 * k)) - 1))),) for k in range(32)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long"), 1)
    assert simhash.components(edges).select("label").distinct().count() == 1


def test_near_duplicates_keep_one_row(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "other words stand here now"), (None, "a b c d e")]
    assert sorted((r["doc_id"] or -1) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()) == [-1, 1, 3]
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def five_words(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(min(1, len(w)), len(w) - 4))}


@pytest.mark.parametrize("pairs_up_to", [8, 1])
def test_near_duplicates_of_the_pipeline_against_brute_force(spark, pairs_up_to):
    import corpus_pipeline

    rng = random.Random(13)
    fresh = lambda n: ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]
    texts = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one two", 5: "a b c d", 6: "A b c d"}
    for f in range(12):
        base = fresh(rng.choice([120, 300]))
        for _ in range(30 if f == 0 else 4):
            w = list(base)
            for p in rng.sample(range(len(w)), round(len(w) * rng.choice([0.005, 0.015, 0.02, 0.03]))):
                w[p] = "x" + str(rng.randint(0, 9999))
            texts[len(texts)] = " ".join(w)
    sets = {i: five_words(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(docs(spark, texts.items()), pairs_up_to=pairs_up_to).collect()}
    assert got == {i: root(i) for i in texts}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts.items()), "").collect()}
    assert kept == {i for i in texts if root(i) == i}
    assert neardup.classes(docs(spark, [])).count() == 0


def test_two_large_classes_that_share_a_key_take_few_rounds(spark, monkeypatch):
    # Texts of a class share 99 of 100 shingles, those of different classes 79: no pair links the classes.
    held = {i: [*range(79), *range(1000 * (i // 40), 1000 * (i // 40) + 20), 10_000 + i] for i in range(40, 120)}
    shared = spark.createDataFrame([(1, i, 100, len(held)) for i in held], "key long, fp long, n int, of long")
    rounds, whole = [], neardup.components

    def counted(edges):
        rounds.append(1)
        assert len(rounds) <= 6
        return whole(edges)

    monkeypatch.setattr(neardup, "components", counted)
    label = neardup.links(shared, spark.createDataFrame(list(held.items()), "fp long, held array<long>"))
    assert {r["node"]: r["label"] for r in label.collect()} == {i: i // 40 * 40 for i in held}


def slow_fingerprint_and_blocks(held, tables, bits, many):
    one, two = (t.view(np.int8).tolist() for t in tables)
    sums = [sum(2 * (one[int(h) & 4095][i] ^ two[int(h) >> 12 & 4095][i]) + 1 for h in held) for i in range(len(one[0]))]
    out = []
    for b in range(many):
        part = sums[b * bits : (b + 1) * bits]
        value = sum((v > 0) << i for i, v in enumerate(part))
        i, j = sorted(range(bits), key=lambda i: abs(part[i]))[: neardup.UNSURE]
        out += [b << bits | value ^ x for x in (0, 1 << i, 1 << j, 1 << i | 1 << j)]
    return sum((v > 0) << i for i, v in enumerate(sums[: neardup.CHECK])), out


def test_near_duplicates_meet_in_simhash_blocks(spark):
    rng = random.Random(14)
    texts = {i: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)) for i, n in enumerate((8, 9, 60, 300))}
    texts[4] = texts[2] + " more"
    bits, many = 18, 8
    tables = neardup.vote_tables(max(neardup.CHECK, many * bits))
    seen = neardup._sketches(docs(spark, texts.items()), "doc_id", "text", 5, bits, many)
    row = {r["doc_id"]: r for r in seen.collect()}
    keyed = neardup._keys(seen, bits, many)
    keys = {(r["fp"], r["key"] >> 31, r["key"] & (1 << 31) - 1) for r in keyed.collect()}
    wanted = set()
    for i, t in texts.items():
        check, found = slow_fingerprint_and_blocks(neardup.shingles(t), tables, bits, many)
        assert (row[i]["s"] & (1 << 64) - 1) | (row[i]["t"] & (1 << 64) - 1) << 64 == check
        wanted |= {(row[i]["fp"], k, row[i]["n"]) for k in found}
    assert keys == wanted
    pairs = neardup._met(keyed, 0.8, 8).select("fp", "other").distinct().collect()
    assert [{r["fp"], r["other"]} for r in pairs] == [{row[2]["fp"], row[4]["fp"]}]


def test_simhash_blocks_lose_no_pair_of_the_similarity():
    rng, bits = np.random.default_rng(15), 18
    many = neardup.blocks(bits)
    tables = neardup.vote_tables(many * bits)
    lost = 0
    for _ in range(150):
        for c, x, y in ((4, 1, 0), (8, 1, 1), (8, 2, 0), (24, 3, 3), (240, 30, 30)):
            h = rng.integers(0, 1 << 63, c + x + y, dtype=np.uint64)
            a, b = neardup.votes(h[: c + x], *tables), neardup.votes(np.r_[h[:c], h[c + x :]], *tables)
            sure = [np.argsort(np.argsort(np.abs(v).reshape(many, bits), axis=1), axis=1) >= neardup.UNSURE for v in (a, b)]
            differ = (a > 0) != (b > 0)
            met = ~np.any(differ.reshape(many, bits) & sure[0] & sure[1], axis=1)
            lost += not met.any() or np.count_nonzero(differ[: neardup.CHECK]) > neardup.radius()
    assert lost <= 2  # 750 pairs, 0.05 expected


@pytest.mark.parametrize("batch", [10_000, 7])
def test_simhash_blocks_meet_across_batches(spark, batch):
    rng = random.Random(16)
    base = rng.getrandbits(128)
    rows = []
    for i in range(400):
        bits = base if i % 2 else rng.getrandbits(128)
        for b in rng.sample(range(128), 12):
            bits ^= 1 << b
        signed = [int(np.uint64(x).view(np.int64)) for x in (bits & (1 << 64) - 1, bits >> 64)]
        rows.append((min(rng.randrange(30), rng.randrange(60)), rng.choice([40, 50, 60]), i, *signed, bits))
    rows += [(99, 50, 1000 + i, *rows[1][3:]) for i in range(70)]
    expected, members = set(), set()
    for k in {r[0] for r in rows}:
        at = [r for r in rows if r[0] == k]
        if len(at) > 16:
            members |= {(k, r[2], r[1]) for r in at}
        else:
            expected |= {frozenset((a[2], b[2])) for a, b in combinations(at, 2) if (a[5] ^ b[5]).bit_count() <= neardup.radius() and 5 * min(a[1], b[1]) >= 4 * max(a[1], b[1])}
    keyed = spark.createDataFrame([(r[0] << 31 | r[1], *r[2:5]) for r in rows], "key long, fp long, s long, t long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = neardup._met(keyed, 0.8, 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {frozenset((r["fp"], r["other"])) for r in got if r["other"] is not None} == expected and expected
    assert {(r["key"], r["fp"], r["n"]) for r in got if r["other"] is None} == members and len(members) > 70


# Packing


def test_packing_is_gapless_and_tight(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from worldframe.llm.queries import tokenizer_path

    rng = random.Random(2)
    texts = [(i, " ".join(words(rng, rng.choice([1, 20, 300, 900])))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "<|endoftext|> it's 3 o'clock now"), (203, "word " * 5000), (204, "word " * 5000), (205, "ÉÀ  ß\tx")]
    texts += [(206, "a\u00a0b\x1cc \x01 x\u0301 \u0301y\u2003z\x85 \x0b"), (207, "x" * 60_000 + " " + "é" * 9000), (208, "\x01"), (209, " \n ")]
    got = packing.pack(docs(spark, texts), tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["length"]) == (2048 * r["piece"], len(part))
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    least = max(-(-sum(r["length"] for r in got) // 2048), sum(r["length"] > 1024 for r in got))
    assert len(by_sequence) <= least + 2
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_packing_of_repeated_rows_and_odd_columns(spark):
    pytest.importorskip("public_tokenizers")
    from worldframe.llm.queries import tokenizer_path

    rows = [(None, "a b c", 1, 2)] * 40 + [(7, "a b c", 3, 4)] * 5 + [(8, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece long, salt long").withColumn("row", F.lit("x")).withColumn("rank", F.lit(1))
    got = packing.pack(df, tokenizer_path()).collect()
    assert len(got) == 46 and len({(r["sequence_id"], r["offset"]) for r in got}) == 46
    assert sorted(r["length"] for r in got) == [1] + [4] * 45


def test_encoder_forgets_and_parts(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from worldframe.llm.queries import tokenizer_path

    monkeypatch.setattr(packing, "CACHE", 10)
    encoder, rng = packing.Encoder(tokenizer_path()), random.Random(31)
    texts = pa.array([" ".join("".join(rng.choices("abcdé", k=4)) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None])
    parts = list(common.parts(texts, 200))
    assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) == 61
    for lo, n in parts:
        ids, bounds = encoder.encode(texts.slice(lo, n))
        for i in range(n):
            want = encoder.tokenizer.encode(texts[lo + i].as_py() or "", add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*want, 0]


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        used = defaultdict(int)
        for parts, n in packing.plan(histogram):
            assert sum(parts) <= 2048 and n > 0
            for k in parts:
                used[k] += n
        assert dict(used) == histogram


# Toxicity


def test_toxicity_tolerates_inserted_characters():
    rng = random.Random(4)
    bad = ["blockhead", "numbskull", "dimwit"]
    rows = []
    for i in range(600):
        w = words(rng, 60)
        if i % 3 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((" ".join(w) + ".", int(i % 3 == 0)))
    model = toxicity.fit(rows)
    score = lambda t: model.score(model.texts([t])[0])
    assert score("alpha beta blockhead gamma") > 0.5 > score("alpha beta gamma delta") >= 0
    for spoilt in ("block-head", "b l o c k h e a d", "n.u.m.b.s.k.u.l.l", "blockxhead", "numbsskull", "DIMWIT!"):
        assert score(f"alpha {spoilt} beta") > 0.3, spoilt
    assert score(None) == score("") <= 0.3
    assert score("a" * 100_000) < 0.3


def test_toxicity_needs_both_labels(spark):
    assert toxicity.fit([]).score(0.0) < 0.01
    assert abs(toxicity.fit([("a", 1), ("b", 0), ("c", 0), ("d", 0)]).score(9.0) - 0.25) < 1e-6
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, [(1, "x")]), empty)
    out = toxicity.score(docs(spark, [(1, None), (2, "y")]), model).collect()
    assert len(out) == 2 and all(r["score"] < 0.01 for r in out)
    assert toxicity.score(docs(spark, []), model).count() == 0


# Line dedup


def test_line_dedup_drops_recurring_templates_only(spark):
    rng = random.Random(5)
    fresh = lambda i: " ".join("w" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(12))
    rows, own = [], {}
    for i in range(40):
        own[i] = [fresh(i), "", fresh(i)]
        lines = list(own[i])
        if i % 4 == 0:
            lines.insert(1, "Copyright by the authors, all rights kept")
        if i % 4 == 1:
            lines.append(f"Posted on day {i} of 2020 in the garden section of the page by user {i * 7}")
        rows.append((i, "\n".join(lines)))
    copy = "\n".join(fresh(0) for _ in range(4))
    rows += [(100 + k, copy) for k in range(30)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, own[3][0])]
    got = {r["doc_id"]: r for r in linededup.drop_recurring_lines(docs(spark, rows), counts=True).collect()}
    for i in range(40):
        assert got[i]["text"] == "\n".join(own[i])
        assert got[i]["n_chars"] == (len(got[i]["text"]) if i % 4 < 2 else len(rows[i][1]))
    assert all(got[100 + k]["text"] == copy for k in range(30))
    assert (got[200]["text"], got[201]["text"], got[202]["text"]) == (None, "", "\n\n")
    assert linededup.drop_recurring_lines(docs(spark, [])).count() == 0


def line_keys(line):
    """The exact template of a line, and its generalised ones by tree and leaf, in plain Python."""
    t = [re.sub(r"^[^0-9]*[0-9].*", "<*>", w) for w in line.split(" ") if w]
    n = len(t)
    step = max(0, -(-(n - 3) // 4))
    m = [tuple(t[2 + step * i : min(2 + step * (i + 1), n - 1)]) for i in range(4)]
    trees = {}
    vary = 2 if n >= 8 else 1
    if n >= 4:
        trees["lead", n, t[0], t[1]] = [m[0], m[1], m[2], (m[3], t[-1])]
    if n > 4:
        trees["bound", n, t[0], t[-1]] = [(t[1], m[0]), m[1], m[2], m[3]]
    return " ".join(t), {leaf: [(leaf, tuple((i, f[i]) for i in c)) for c in combinations(range(4), 4 - vary)] for leaf, f in trees.items()}


def slow_line_dedup(texts):
    texts = {t for t in texts if t is not None}
    lines = {t: {i: x.strip(" \t\r") for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")} for t in texts}
    leaf = defaultdict(list)
    for t in texts:
        for x in lines[t].values():
            exact, trees = line_keys(x)
            for k in trees:
                leaf[k].append(exact)
    keys = {t: {i: {e} | {g for k, gs in trees.items() if len(leaf[k]) >= 5 and len(set(leaf[k])) > 1 for g in gs} for i, x in ls.items() for e, trees in [line_keys(x)]} for t, ls in lines.items()}
    holds = defaultdict(set)
    for t in texts:
        for ks in keys[t].values():
            for k in ks:
                holds[k].add(t)
    kin = {t: s for t in texts if (s := {k for ks in keys[t].values() for k in ks if len(holds[k]) >= 5})}

    def marks(x):
        """The pieces of twelve characters or more with the four least hashes, or in short lines each token with its place."""
        words = line_keys(x)[0].split(" ")
        pieces = [p for p in re.split(linededup._CUT, " ".join(words)) if len(p) >= 12]
        least = sorted(pieces, key=lambda p: np.uint64(xxhash.xxh64_intdigest(p.encode(), seed=42)).astype(np.int64))
        return {(len(words), i, w) for i, w in enumerate(words)} if len(words) < 8 else set(least[:4])

    mine = {t: {i: marks(x) for i, x in lines[t].items()} for t in kin}

    def near(t, i, other):
        return any(mine[t][i] & m for m in mine[other].values())

    weight = {}
    for t in kin:
        held = {i: max(len(holds[k]) for k in keys[t][i]) for i in lines[t]}
        held = {i: max(f, 1 + sum(near(t, i, o) for o in kin if o != t and kin[o] & kin[t])) for i, f in held.items()}
        by = sorted((f, len(lines[t][i])) for i, f in held.items())
        total, own = sum(x for _, x in by), sum(x for f, x in by if f == 1)
        seen, median = own, 1
        for f, x in by:
            if f > 1 and 2 * seen < total:
                seen, median = seen + x, f
        weight[t] = (total, own, median, sum(len(lines[t][i].split()) for i, f in held.items() if f == 1))
    n = defaultdict(float)
    for k, ts in holds.items():
        for t in ts:
            if t not in weight:
                continue
            total, own, median, words = weight[t]
            taken = sum(len(lines[t][i]) for i, ks in keys[t].items() if k in ks)
            n[k] += 1 if 2 * own >= total - taken or words >= 4 else 1 / median
    return {t: {i for i, ks in keys[t].items() if any(len(holds[k]) > 1 and n[k] >= 5 - 1e-6 for k in ks)} for t in texts}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(15)
    fresh = lambda n: ["".join(rng.choices("abcdef", k=5)) for _ in range(n)]
    shared = [fresh(n) for n in (1, 2, 3, 4, 5, 7, 9, 12, 12, 20)]
    texts = [None, "", " \n\t"]
    for _ in range(150):
        lines = [fresh(rng.randint(1, 20)) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 3)):
            w = list(rng.choice(shared))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice([fresh(1)[0], "x7"])
            lines.insert(rng.randint(0, len(lines)), w)
        texts.append("\n".join(rng.choice(["", " "]) + " ".join(x) for x in lines))
    for size in (30, 8, 3):  # groups of near copies
        base = [fresh(12) for _ in range(8)]
        for _ in range(size):
            lines = [list(x) for x in base]
            for _ in range(3):
                lines[rng.randrange(8)][rng.randrange(12)] = fresh(1)[0]
            texts.append("\n".join(" ".join(x) for x in lines))
    texts += texts[5:9] * 3 + ["word " * 30_000 + "\n" + "\n".join(" ".join(fresh(4)) for _ in range(3000))]
    want = slow_line_dedup(texts)
    got = linededup.drop_recurring_lines(docs(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["text"] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[t]))
    assert sum(len(x) for x in want.values()) > 100
    copies = texts[153:183]
    assert len({len(t.split("\n")) for t in copies}) == 1 and not any(want[t] for t in copies)


def test_line_dedup_loses_no_template_to_a_hash(spark):
    rng = random.Random(16)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    every = [fresh(10) for _ in range(12)]  # twelve lines that all documents hold: one of them has the least hash of all, whatever the hash
    rows = [(i, "\n".join([fresh(60), *every[:1], fresh(60), *every[1:], fresh(60), *(fresh(30) for _ in range(4))])) for i in range(300)]
    rows += [(1000 + i, f"User {fresh(1)} logged in from the garden") for i in range(40)]
    rows += [(2000 + i, f"{fresh(1)}\nThe one line at the end of each short note") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(docs(spark, rows)).collect()}
    assert all(not set(got[i].split("\n")) & set(every) and len(got[i].split("\n")) == 7 for i in range(300))
    assert all(got[1000 + i] == "" for i in range(40))
    assert all("\n" not in got[2000 + i] and got[2000 + i] for i in range(20))


@pytest.mark.parametrize("shared", [1, 3, 8, 20])
def test_line_dedup_of_texts_that_are_mostly_shared(spark, shared):
    """However much a text shares, its shared lines go if it says anything of its own, however little."""
    rng = random.Random(shared)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    every = [fresh(10) for _ in range(shared)]
    rows = []
    for own in (1, 2, 6, 20):
        for _ in range(12):
            lines = [fresh(rng.choice([4, 5, 9, 12])) for _ in range(own)]
            at = rng.randint(0, own)
            rows.append((len(rows), "\n".join(lines[:at] + every + lines[at:])))
    got = {r["doc_id"]: r["text"].split("\n") for r in linededup.drop_recurring_lines(docs(spark, rows)).collect()}
    assert not any(set(got[i]) & set(every) for i, _ in rows)
    assert all(got[i] == [x for x in t.split("\n") if x not in every] for i, t in rows)


def test_line_dedup_keeps_near_copies(spark):
    """Copies with edits anywhere, some in most fields of a line, are one text: nothing of theirs goes."""
    rng = random.Random(8)
    fresh = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    rows = []
    for size in (6, 40, 150):
        base = [fresh(n) for n in (40, 60, 3, 50, 5, 70)]
        for _ in range(size):
            lines = [list(x) for x in base]
            for _ in range(12):
                w = rng.choices(lines, weights=[len(x) for x in lines])[0]
                w[rng.randrange(len(w))] = fresh(1)[0]
            rows.append((len(rows), "\n".join(map(" ".join, lines))))
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(docs(spark, rows)).collect()}
    assert got == dict(rows)


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(i, " ".join(chr(97 + i) * k for k in range(2, 9)) + "\nThe same line", 1, 2, 3, 4, 5) for i in range(8)] + [(None, None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, __key int, __drop int, __Lines int, n_lines int, n_chars int")
    got = linededup.drop_recurring_lines(df, counts=True)
    assert got.columns == [*df.columns, "n_dropped"]
    for r in got.collect():
        if r["doc_id"] is None:
            assert (r["text"], r["n_lines"], r["n_dropped"]) == (None, 0, 0)
        else:
            assert (r["__key"], r["__drop"], r["__Lines"], r["n_lines"], r["n_dropped"]) == (1, 2, 3, 2, 1) and r["n_chars"] == len(r["text"])


# Decontamination


def test_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        d[:, 0], d[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + (a[i] != b[j]))
        assert decontaminate.edit_distance(a, b) == d[-1, -1]
        assert decontaminate.best_end(a, b)[0] == d[-1].min()


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(6)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    items = [(i, fresh(rng.randint(12, 50))) for i in range(40)]
    rows, expected = [], set()
    for k, (i, w) in enumerate(items * 3):
        v = list(w)
        for _ in range(rng.randint(0, len(w) // 5)):
            p, kind = rng.randrange(len(v)), rng.randrange(3)
            if kind == 0:
                v[p] = "zzzzz"
            elif kind == 1:
                del v[p]
            else:
                v.insert(p, "yyyyy")
        rows.append((k, " ".join(fresh(30) + [x.upper() + "," for x in v] + fresh(30))))
        expected.add((k, i))
    rows += [(500 + k, " ".join(fresh(200))) for k in range(30)] + [(600, None), (601, ""), (602, "word " * 50_000)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "word other")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, rows), bench).collect()}
    assert got <= expected and len(got) >= 0.97 * len(expected)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in got}
    assert decontaminate.find(docs(spark, []), bench).count() == 0
    assert decontaminate.find(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_allows_edits_in_the_first_words(spark):
    rng = random.Random(14)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    items = [(i, fresh(15 + i % 40)) for i in range(120)]
    rows = []
    for i, w in items:
        v, most = list(w), len(w) // 5
        for _ in range(most):  # all the edits allowed, among the first words
            p, kind = rng.randrange(2 * most), rng.randrange(3)
            v[p : p + (kind < 2)] = [] if kind == 1 else ["zzzzz"]
        rows.append((i, " ".join(fresh(30) + v + fresh(30))))
    five, lost = fresh(5), fresh(20)
    rows += [(500, " ".join(fresh(9) + five[:2] + ["zzzzz"] + five[3:] + fresh(9))), (501, " ".join(fresh(9) + lost + fresh(9))), (502, " ".join(fresh(50)))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(500, " ".join(five)), (None, " ".join(lost)), (None, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, rows), bench).collect()}
    assert got == {(i, i) for i, _ in items} | {(500, 500), (501, None)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()] == [502]
    w = np.arange(1, 11)
    assert decontaminate.best_span(w, np.array([0, 0, 1, 0, *range(2, 11), 0])) == (1, 4, 9)
    assert decontaminate.best_span(w, np.array([0, 0, *range(1, 5), 0, *range(5, 11)])) == (1, 2, 11)


# Chat


def test_chat_round_trip(spark):
    odd = ["", "~0~1", "<|end|>", "<|turn|>user<|text|>x<|end|>", "</s>[INST] ok [/INST]", "a\n<|text|>|", "🙂 <|raw|>", None, "<|esc|>~2"]
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system", "a<|text|>b", None]), odd[(c * 5 + t) % len(odd)]) for c in range(30) for t in range(1 + c % 6)]
    rows += [(None, 0, "user", "x"), (99, None, "assistant", "z"), (99, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


# Quality


def test_quality_learns_rules():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(quality.NAMES)))
    y = ((x[:, 1] < 0.6) & (x[:, 4] < 0.8)).astype(float)
    rules = quality.fit(x[:1500], y[:1500])
    assert ((rules.scores(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97
    assert len(rules.rules) < 120


def test_quality_column_equals_numbers(spark):
    rng = random.Random(7)
    texts = [(i, " ".join(words(rng, 30)).upper() + "!!" if i % 2 else " ".join(words(rng, 30))) for i in range(300)] + [(900, None), (901, ""), (902, "\n \t")]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rules = quality.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, rules).collect()}
    x = {r["doc_id"]: [r[n] for n in quality.NAMES] for r in quality.with_statistics(df).collect()}
    want = rules.scores(np.array(list(x.values())))
    assert np.allclose([got[i] for i in x], want)
    assert all((got[i] > 0.5) == (i % 2 == 0) for i in range(300))
    assert quality.score(df.limit(0), rules).count() == 0


# HTML


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page("<nav><a href=x>Menu</a></nav><article><h1>Head &amp; line</h1><p>One <b>two<br><p>three&nbsp;&#233;</p></article><footer>f</footer>"), "Head & line\nOne two\nthree é"),
        (page('<div class="ad">buy</div><main><p>a</p><aside>s</aside><form><p>f</p></form><ul><li>x<li>y</ul></main><section id="comments"><article class="comment"><p>me</p></article></section>'), "a\nx\ny"),
        (page('<div class="cookie-notice">c</div><div class=sidebar>s</div><p title="a > b">kept</p>'), "kept"),
        ("<p>cut <b>off", "cut off"),
        ("1 < 2 &lt; 3 <!-- x --> y <![CDATA[z]]>", "1 < 2 < 3 y"),
        ("<article><p>a</p><script>if (a<b) '</p>'", "a"),
        ("", ""),
        (None, ""),
        ("<" * 5000, "<" * 5000),
    ],
)
def test_html_text(html, text):
    assert htmltext.Page(html).main_text() == text


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article class='post category-privacy'><p>a</p></article>", "a"),
        ("<div class='layout has-sidebar'><article><p>a</p></article><div class='site-footer'>f</div></div>", "a"),
        ("<div class='content header-less'><p>a</p></div><div class='ad'>b</div>", "a"),
        ("<main class='post tag-social'><p>a</p><div class='share-buttons'>s</div></main>", "a"),
        ("<p>x</p><div class='sidebar'><article><p>a</p></article></div>", "a"),
        ("<article><p>a</p></article><div class='sidebar'><article>other</article></div>", "a"),
        ("<article><header class='entry-header'><h1>Title</h1></header><p>a</p></article>", "Title\na"),
        ("<div class='content no-sidebar'><p>hello</p></div>", "hello"),
        ("<article><p>one <span class='ad'>buy</span> two <span class='ad'>x<div>y</div>z</span> three</p></article>", "one two three"),
        ("<article><p>a <math><mi>x</mi></math> <object>plain</object> b<video>v</video></p></article>", "a x plain bv"),
        ("<div>story</div><section id='comments'><article class='comment'><p>me</p></article></section>", "story"),
    ],
)
def test_html_names_do_not_lose_articles(body, text):
    assert htmltext.Page(page(body)).main_text() == text


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [(i, "http://H.example/p", f"<div><span class=x></span><div class='top'>Same words on each page</div><div class='story'>Story {i} of many</div></div>") for i in range(20)]
    rows += [(50, None, "<p>x</p>"), (51, "nonsense", None), (52, "http://other.example", "<div class='top'>Same words on each page</div>")]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} of many" for i in range(20))
    assert (got[50], got[51], got[52]) == ("x", "", "Same words on each page")
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_against_its_definition(spark):
    rng, rows = random.Random(21), []
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    notice, article = "Sign the petition of this site today", [fresh(9) for _ in range(5)]
    for i in range(60):
        own = [fresh(12) for _ in range(2 + i % 4)]
        own.insert(1, notice) if i % 10 else None
        rows.append((i, "https://a.example/x", "<article><h1>" + fresh(3) + "</h1>" + "".join(f"<p>{x}</p>" for x in own) + "</article>"))
    for i in range(100, 170):  # near copies of one article, each with a paragraph of its own
        rows.append((i, "https://a.example/y", "<article>" + "".join(f"<p>{x}</p>" for x in [*article, fresh(9), notice]) + "</article>"))
    for i in range(200, 203):  # a small host: three pages are no ground to drop what they share
        rows.append((i, "https://small.example/y", f"<article><p>Chapter heading</p><p>{fresh(9)}</p></article>"))
    rows += [(300, "https://a.example/z", rows[3][2])] * 3 + [(None, None, None), (None, "https://a.example", "")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "page_id long, url string, html string, node int, Host int")
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None}
    for i, _, source in rows:
        if source:
            want = [b[3] for b in htmltext.Page(source).candidates()]
            assert by[i].split("\n") == [x for x in want if x != notice], i
    assert all(by[i].startswith("Chapter heading\n") for i in range(200, 203))
    # The numbers of the tree, by hand: weights by the median block, K and M, the entropy of the shapes.
    tree = {r["node"]: r["importance"] for r in htmltext.style_tree(htmltext.read(df))[0].where("host = 'a.example'").collect()}
    pages = {s: htmltext.Page(s).candidates() for _, u, s in rows if s and u.startswith("https://a.")}
    k = defaultdict(int)
    for blocks in pages.values():
        for b in {(b[1], b[3]) for b in blocks}:
            k[b] += 1
    weight = {s: 1 / sorted(k[b] for b in {(b[1], b[3]) for b in blocks})[(len({(b[1], b[3]) for b in blocks}) - 1) // 2] for s, blocks in pages.items()}
    branch = next(b[1] for b in pages[rows[1][2]] if b[3] == notice)
    m = sum(weight[s] for s, blocks in pages.items() if any(b[1] == branch for b in blocks))
    n = sum(weight[s] for s, blocks in pages.items() if any(b[3] == notice for b in blocks))
    shapes = defaultdict(float)
    for s in pages:
        shapes[tuple(htmltext.re.findall("<(h1|p)>", s))] += weight[s]
    every = sum(shapes.values())
    varied = (np.log(every) - sum(x * np.log(x) for x in shapes.values()) / every) / np.log(every + htmltext.PRIOR)
    assert abs(tree[htmltext._hash(branch, notice)] - (1 - np.log(n) / np.log(m + htmltext.PRIOR)) * (1 + varied) / 2) < 1e-9


def test_html_deep_and_long_pages():
    deep = "<div class=a>" * 100_000 + "core" + "</section></p>" * 1000
    assert htmltext.Page(deep).main_text() == "core"
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(50_000)) + "</article>"
    assert htmltext.Page(long).main_text().count("\n") == 49_999


# Top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.3 + c for c in rng.normal(size=(4, 8))] + [np.tile(rng.normal(size=8), (60, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5040, [float("nan")] + [0.0] * 7), (5060, [None] + [0.0] * 7), (5080, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (5100, [])]
    rows += [(len(x), [9.0] * 7), (len(x) + 1, [0.0] * 7)]  # shorter vectors: zero where they have no component
    x = np.concatenate([x, [[9.0] * 7 + [0.0], [0.0] * 8]]).astype(np.float32)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    got = defaultdict(dict)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, shard=500, queries=16).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, len(x), 20))
    for q in got:
        s = whole @ whole[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:20]
        assert got[q] == {k + 1: (i, s[i]) for k, i in enumerate(order)}
    again = topk.top_k(df.where("vec_id < 3").withColumn("s", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("v", F.lit(0)), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in again] == [1, 2]
    few = topk.top_k(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_skips_computations():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(500, 4)) + 40 * c for c in rng.normal(size=(12, 4))])
    x = np.floor(64 * x)
    tree = topk.Tree(np.arange(len(x)), x, float((x * x).sum(axis=1).max()))
    tree.search(np.arange(0, len(x), 50), x[::50], 5)
    assert tree.computed < 0.5 * len(x) * len(x[::50])


# Repeats


def test_minimisers_are_shared():
    rng = np.random.default_rng(10)
    same = rng.integers(0, 1000, repeats.LEAST).astype(np.uint32)
    for _ in range(50):
        texts = [np.concatenate([rng.integers(0, 1000, rng.integers(0, 80)).astype(np.uint32), same, rng.integers(0, 1000, 60).astype(np.uint32)]) for _ in range(2)]
        h = [repeats.grams(t) for t in texts]
        a, b = (set(x[repeats.minimisers(x)].tolist()) for x in h)
        assert a & b


def test_repeated_spans_are_found(spark):
    rng = random.Random(11)
    fresh = lambda n: ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]
    passage, long_one = fresh(70), fresh(900)
    texts, expected = [], {}
    for i in range(25):
        before, after = fresh(rng.randint(0, 90)), fresh(rng.randint(60, 90))
        if i % 5 == 0:
            texts.append((i, " ".join(before + passage + after)))
            expected[i] = (len(before), len(before) + 70)
        elif i in (1, 2):
            texts.append((i, "\n".join(before + long_one + after)))
            expected[i] = (len(before), len(before) + 900)
        else:
            texts.append((i, " ".join(before + fresh(70) + after)))
    twice = fresh(60)
    texts += [(100, " ".join(twice + fresh(70) + twice)), (101, None), (102, ""), (103, "short text"), (104, " ".join(long_one[:40] + fresh(80)))]
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in repeats.repeated_spans(docs(spark, texts)).collect()}
    assert got == expected
    assert repeats.repeated_spans(docs(spark, [])).count() == 0


def slow_spans(texts):
    """Union of the runs of LEAST words that another document holds, for each (id, text)."""
    rows = sorted({(i, t) for i, t in texts if t}, key=str)
    least = repeats.LEAST
    split = {r: r[1].split() for r in rows}
    holders = defaultdict(set)
    for r, w in split.items():
        for i in range(len(w) - least + 1):
            holders[tuple(w[i : i + least])].add(r)
    out = set()
    for r, w in split.items():
        starts = [i for i in range(len(w) - least + 1) if len(holders[tuple(w[i : i + least])]) > 1]
        spans = []
        for i in starts:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + least
            else:
                spans.append([i, i + least])
        out |= {(r[0], a, b) for a, b in spans}
    return out


@pytest.mark.parametrize("few", [32, 2])
def test_repeated_spans_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(repeats, "FEW", few)
    rng = random.Random(17 + few)
    fresh = lambda n: ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]
    texts = []
    for _ in range(60):  # triples: the second shares some words with the first, the third the last of these and more
        n, m = rng.randint(44, 70), rng.randint(8, 45)
        x = fresh(n + 60)
        texts += [fresh(20) + x, fresh(rng.randint(0, 60)) + x[:n] + fresh(30), fresh(25) + x[n - m : n + 40] + fresh(9)]
    for _ in range(6):  # passages that end, or begin, in lines which many documents hold
        line, held = fresh(rng.randint(8, 30)), fresh(rng.randint(22, 45))
        for _ in range(3):
            texts += [fresh(15) + held + line + fresh(30), fresh(15) + line + held + fresh(30)]
        texts += [fresh(rng.randint(20, 60)) + line + fresh(60) for _ in range(25)]
    ends = [fresh(14) for _ in range(4)]
    texts += [fresh(70) + sum(ends, []) for _ in range(20)] + [fresh(50) + ends[0] + fresh(3) + ends[1] for _ in range(20)]
    copy = fresh(140)
    texts += [list(copy) for _ in range(20)] + [copy[:60] + fresh(9) + copy[70:] for _ in range(10)] + [fresh(30_000) + copy[40:100]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += rows[:3] + [(5, rows[100][1]), (None, rows[7][1]), (None, rows[7][1]), (None, " ".join(fresh(80))), (900, None), (901, ""), (902, " \n")]
    got = [(r["doc_id"], r["start_word"], r["end_word"]) for r in repeats.repeated_spans(docs(spark, rows).withColumn("row", F.lit(1)).withColumn("gram", F.lit(2)).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(slow_spans(rows), key=str)


def test_copies_are_covered_whole(spark):
    rng = random.Random(12)
    text = " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(300))
    got = repeats.repeated_spans(docs(spark, [(i, text) for i in range(60)]).repartition(8)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == {(i, 0, 300) for i in range(60)}


# Queries


def test_queries_over_the_small_tables(spark):
    import os

    from worldframe.llm.queries import QUERIES

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    for name in ("op7_chat_format", "op9_html_text"):
        assert QUERIES[name](spark, at).count() > 0
    last = [r for r in QUERIES["op7_chat_format"](spark, at).where("conv_id = -1").collect()][0]
    said = "</s>[INST] ok [/INST]"
    assert (last["n_turns"], last["loss_chars"]) == (2, len(said))
    assert last["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_pipeline_over_the_small_tables(spark):
    import os

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    out = corpus_pipeline.run(spark, at)
    held = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert out.count() > 0 and held.where("n <> m OR n > 2048").count() == 0


# Clashing names, rows without an id and repeated rows


def clashing(spark, rows, *names):
    df = docs(spark, rows)
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(i))
    return df


def test_clashing_names_and_repeated_rows(spark):
    rng = random.Random(41)
    rows = [(i, " ".join(words(rng, 30)) + " blockhead" * (i % 2)) for i in range(60)] + [(None, "x y z"), (None, None), (3, "again"), (3, "again"), (70, "long " * 200_000)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    df = clashing(spark, rows, "Score", "__upper", "__keep", "y", "fp", "row", "keys", "label", "lines", "piece", "first_word")
    model, rules = toxicity.train(df, labels), quality.train(df, labels)
    for scored in (toxicity.score(df, model), quality.score(df, rules)):
        assert scored.columns == [c for c in df.columns if c != "Score"] + ["score"]
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["__upper"] == 1 for r in got)
    assert len({r["score"] for r in toxicity.score(df, model).where("doc_id = 3 AND text = 'again'").collect()}) == 1
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r["__keep"] for r in kept.collect()} == {2} and kept.where("doc_id IS NULL").count() == 2
    for found in (simhash.classes(df), neardup.classes(df)):
        assert found.count() == len(rows) and found.where("doc_id IS NULL").count() == 2
    bench = clashing(spark, [(1, " ".join(rows[5][1].split()[3:25])), (2, "nothing of the kind here at all")], "row").select(F.col("doc_id").alias("item_id"), "text", "row")
    assert 5 in [r["doc_id"] for r in decontaminate.find(df, bench).collect()]
    assert decontaminate.drop_contaminated(df, bench).columns == df.columns
    for labelled in (df, docs(spark, [])):
        assert toxicity.train(labelled, labels.limit(0)) and quality.train(labelled, labels.limit(0)).rules == []
    few = quality.labelled_sample(docs(spark, [(0, "b"), (0, "a"), (0, None), (1, "c")]), labels, "quality", 5, 5).collect()
    assert sorted((r["doc_id"], r["text"]) for r in few if r["doc_id"] == 0) == ([(0, "")] if few and any(r["doc_id"] == 0 for r in few) else [])


def test_item_blocks_are_checked_one_by_one(spark, monkeypatch):
    rng = random.Random(42)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    items = [(i, fresh(20)) for i in range(30)] + [(7, fresh(20)), (None, fresh(20))]
    rows = [(i, fresh(10) + " " + t + " " + fresh(10)) for i, (_, t) in enumerate(items)] + [(100, fresh(60))]
    bench = spark.createDataFrame(items + items[:4], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 8)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, rows), bench).collect()}
    assert got == {(i, k) for i, (k, _) in enumerate(items)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()] == [100]


def test_walks_reach_the_recall_or_all_windows_are_verified():
    rng = random.Random(43)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    assert 0 < decontaminate.Items([(i, fresh(rng.randint(15, 60))) for i in range(150)]).walks <= decontaminate.WALKS[-1]
    short = [(i, fresh(rng.randint(5, 20))) for i in range(150)]
    items = decontaminate.Items(short)
    edited = ["a b c " + " ".join(["zzzzz", *t.split()[1:]]) + " d e" for _, t in short]  # the first word edited: the walks of short items rarely meet again
    assert all(m and m[0][0] == i for i, m in enumerate(items.batch(edited)))


# Pipeline


def test_pipeline_against_slow_versions(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rng = random.Random(44)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    notice, items = "This line stands in many of the documents", [fresh(20) for _ in range(4)]
    texts = [fresh(60) + "\n" + fresh(60) + ("\n" + notice if i % 3 == 0 else "") + ("\n" + fresh(8) + " " + items[i % 4] + " " + fresh(8) if i % 7 == 0 else "") for i in range(60)]
    texts += [texts[1], texts[2] + " end", None, "", " \n", "word " * 30_000]
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, texts[5]), (None, None)]
    none = [(None, None, None, None, None)]
    table = docs(spark, rows).unionByName(spark.createDataFrame(none, DOCS)).withColumn("__score", F.lit(1)).withColumn("piece", F.lit(2))
    at = str(tmp_path)
    table.coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (None, None), (9, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, at).collect():
        got[r["doc_id"]].append(r)
    gone = slow_line_dedup([t for _, t in rows])
    clean = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[t]) for i, t in rows if i is not None}
    sets = {i: five_words(t) for i, t in clean.items()}
    first = [i for i in clean if not any(sets[j] == sets[i] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in clean if j < i)]
    want = {i for i in first if not any(x in (clean[i] or "") for x in items)}
    assert {i for i in got if i is not None} == want and any(notice in (t or "") for t in texts) and not any(notice in (t or "") for t in clean.values())
    tokens = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    for i in want:
        ids = np.array([*tokens.encode(clean[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert sorted((r["start"], r["ids_crc32"]) for r in got[i]) == [(s, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
    assert len(got[None]) == 3  # rows without an id stay: none is told apart from another


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
