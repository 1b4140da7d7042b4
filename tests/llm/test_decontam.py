import random
import re
from collections import Counter

import pytest

from spindrift.llm import decontam


@pytest.fixture(scope="module")
def items(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, fp string")

    return make


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w, k):
    return [" ".join(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)]


def brute(docs, items, least=0.8):
    """Best similarity over all windows, one word apart, and the first best window that begins with a shared shingle or is the last."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            if not q or not w:
                continue
            k = min(5, len(q))
            if len(w) < k:
                continue
            b = Counter(grams(q, k))
            best, last = (0, False, 0), max(len(w) - len(q), 0)
            for at in range(last + 1):
                window = grams(w[at : at + len(q)], k)
                a = Counter(window)
                best = max(best, (sum((a & b).values()) / sum((a | b).values()), window[0] in b or at == last, -at))
            if best[0] >= least:
                out[d, i] = max((round(best[0], 6), -best[2]), out.get((d, i), (0, 0)))
    return out


def test_against_brute_force_over_all_windows(docs, items):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench = [(i, passage(rng.choice([1, 3, 5, 9, 14, 30, 60, 90]))) for i in range(30)]
    rows = []
    for d in range(150):
        w = passage(rng.randint(0, 120))
        if d % 2:
            i, p = rng.choice(bench)
            p = list(p)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(p))
                action = rng.random()
                if action < 0.5:
                    p[at] = rng.choice(vocabulary)
                elif action < 0.75:
                    p.insert(at, rng.choice(vocabulary))
                elif len(p) > 1:
                    del p[at]
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    bench = [(i, " ".join(p) + ".") for i, p in bench]
    found = decontam.contaminated(docs(*rows), items(*bench)).collect()
    want = brute(rows, bench)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found} == want
    assert len(found) == len(want) > 30


def test_moved_parts_against_brute_force(docs, items):
    rng = random.Random(7)
    fresh = iter(f"v{i}" for i in range(100_000))
    passage = lambda n: [next(fresh) for _ in range(n)]
    bench = [(i, passage(n)) for i, n in enumerate((60, 60, 90, 45, 9, 120))]
    halves, tail = bench[0][1], bench[1][1]
    changed = [(0, halves[30:] + halves[:30]), (1, tail[-15:] + tail[:-15])]
    for d in range(2, 60):
        p = rng.choice(bench)[1]
        cuts = sorted(rng.sample(range(1, len(p)), rng.choice([1, 1, 2])))
        parts = [p[a:b] for a, b in zip([0, *cuts], [*cuts, len(p)])]
        rng.shuffle(parts)
        changed.append((d, [w for part in parts for w in part][: rng.choice([len(p), len(p) - 2])]))
    rows = [(d, " ".join((passage(rng.choice([0, 3, 40])) + w + passage(rng.choice([0, 3, 40]))))) for d, w in changed]
    bench = [(i, " ".join(p)) for i, p in bench]
    found = decontam.contaminated(docs(*rows), items(*bench)).collect()
    want = brute(rows, bench)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found} == want and (0, 0) in want and (1, 1) in want
    assert len(found) == len(want) > 30


def test_edges(docs, items):
    long = "filler words here " * 40_000
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two three"), (5, long + "alpha beta gamma delta epsilon zeta"), (None, "alpha beta gamma delta epsilon zeta"), (6, "one"), (6, "ONE-two! three?"), (6, "ONE-two! three?")]
    bench = [(1, None), (2, ""), (3, "?!"), (4, "One two, three"), (5, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta")]
    found = decontam.contaminated(docs(*rows), items(*bench)).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == sorted([(4, 4), (5, 5), (None, 5), (6, 4)], key=repr)
    assert {r.start_word for r in found if r.doc_id == 5} == {120_000}
    assert decontam.contaminated(docs(), items(*bench)).collect() == []
    assert decontam.contaminated(docs(*rows), items()).collect() == []
    kept = decontam.decontaminate(docs(*rows), items(*bench))
    assert kept.columns == docs().columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id <> 5").collect() if r.text is not None) == [(2, ""), (3, "..."), (6, "one")]


def test_every_probe_within_the_radius_meets(spark, items):
    table = decontam.benchmark_items(items((1, "a b c d e f g h i j k l")))
    fp = table.first()["fp"] % (1 << 64)
    probes = {(r.block, r.value) for r in decontam._probes(table).collect()}
    rng = random.Random(2)
    for _ in range(500):
        other = fp
        for b in rng.sample(range(64), rng.randint(0, decontam.RADIUS)):
            other ^= 1 << b
        assert any((i, other >> 8 * i & 255) in probes for i in range(8))
