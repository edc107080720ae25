"""Candidate windows of decontamination against all windows, and common phrases; the packing tokenizer on odd letters."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from worldframe.llm import decontaminate, packing


def edited(rng, words, most):
    v = list(words)
    for _ in range(rng.randint(0, most)):
        p, kind = rng.randrange(len(v) + 1), rng.randrange(3)
        if kind == 0 and p < len(v):
            v[p] = rng.choice(["zzz", rng.choice(words)])
        elif kind == 1 and len(v) > 1:
            del v[min(p, len(v) - 1)]
        else:
            v.insert(p, rng.choice(["yyy", rng.choice(words)]))
    return v


@pytest.mark.parametrize(("vocabulary", "seed"), [(3000, 1), (60, 2)])
def test_matches_against_all_windows(vocabulary, seed):
    """Every (text, item) whose best span over the whole text is within the tolerance, 99 of 100 at least; nothing else."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    items = [(i, rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40]))) for i in range(60)]
    known = decontaminate.Items([(i, " ".join(w)) for i, w in items])
    texts = []
    for _ in range(80):
        parts = [rng.choices(words, k=rng.randint(0, 30))]
        for i in rng.sample(range(60), 3):
            most = int(0.2 * len(items[i][1])) if len(items[i][1]) >= 5 else 0
            parts += [edited(rng, items[i][1], most), rng.choices(words, k=rng.randint(0, 9))]
        texts.append([w for p in parts for w in p])
    want = set()
    for d, t in enumerate(texts):
        ids = np.array([known.vocabulary.get(w.encode(), 0) for w in t])
        want |= {(d, known.ids[k], decontaminate.best_span(w, ids)[0]) for k, w in enumerate(known.words) if decontaminate.best_span(w, ids)[0] <= known.most[k]}
    found = {(d, m[0], m[3]) for d, matches in enumerate(known.batch([" ".join(t) for t in texts])) for m in matches}
    assert {m[:2] for m in found} <= {m[:2] for m in want} and len(want) > 200
    assert len(found & want) >= 0.99 * len(want)


def test_a_phrase_in_all_items_and_texts_that_repeat_it():
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    phrase = "what is the name of this".split()
    items = [(i, phrase + fresh(14)) for i in range(4000)]
    known = decontaminate.Items([(i, " ".join(w)) for i, w in items])
    text = " ".join([*phrase * 800, *items[7][1], *phrase * 20, *edited(rng, items[11][1], 4)])
    tracemalloc.start()
    began = time.process_time()
    found = known.matches(text)
    took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [m[0] for m in found] == [7, 11] and found[0][3] == 0
    assert took < 5 and most < 200e6


def test_short_items_with_a_common_phrase():
    """Ten words of which six are common: no choice of runs avoids these, so blocks bound the memory."""
    rng = random.Random(5)
    phrase = "what is the name of this".split()
    items = [(i, phrase + ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4)]) for i in range(1500)]
    known = decontaminate.Items([(i, " ".join(w)) for i, w in items])
    tracemalloc.start()
    found = known.matches(" ".join([*phrase * 300, *items[3][1]]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [m[0] for m in found] == [3] and most < 700e6


def test_packing_ids_of_odd_letters():
    pytest.importorskip("public_tokenizers")
    from worldframe.llm.queries import tokenizer_path

    encoder, rng = packing.Encoder(tokenizer_path()), random.Random(9)
    letters = [chr(c) for c in range(0xC0, 0x250)]
    texts = [f"{a}. {a}b{a}! x{a}?" for a in letters] + ["".join(rng.choices([*"abZ09.,;:!?-' ", *letters, "İ", "́", "日", "ẞ"], k=rng.randint(1, 20))) for _ in range(4000)]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1] - 1].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
