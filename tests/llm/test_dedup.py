import hashlib
import random
import string
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import exact_dedup, line_dedup, simhash
from spindrift.llm.components import components

EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "a b c d e"), (5, "A B C D E"), (5, "A B C D E"), (None, "a b c d e"), (7, "É x"), (8, "é x"), (9, "w " * 60_000)]


def test_exact_dedup_edges(docs):
    out = exact_dedup.exact_dedup(docs(*EDGE)).collect()
    assert len(out) == len(EDGE)
    by_text: dict = {}
    for i, t in EDGE:
        low = (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        by_text.setdefault(hashlib.sha256(low.encode()).hexdigest(), []).append(i)
    for r in out:
        ids = by_text[r.text_sha256]
        assert r.group_size == len(ids) and r.doc_id in ids
        assert r.keep_id == max(i for i in ids if i is not None)
    assert sum(r.kept for r in out) == len(by_text)
    assert exact_dedup.exact_dedup(docs()).collect() == []


@pytest.mark.parametrize("counters", [1, 3, 1023])
def test_exact_dedup_is_the_same_for_any_number_of_counters(docs, counters):
    rng = random.Random(counters)
    rows = [(i, rng.choice(["hot", "Hot", "warm", f"cold {i % 40}", f"one {i}"])) for i in range(400)]
    out = exact_dedup.exact_dedup(docs(*rows, parts=5), counters).collect()
    groups = Counter(t.lower() for _, t in rows)
    largest = {}
    for i, t in rows:
        largest[t.lower()] = max(i, largest.get(t.lower(), -1))
    text = dict(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out} == {
        (i, largest[t.lower()], groups[t.lower()], largest[t.lower()] == i) for i, t in text.items()
    }


def test_misra_gries_keeps_every_heavy_digest(spark):
    rows = [(bytes([i % 3]) if i % 2 else bytes([10 + i % 200]),) for i in range(3000)]
    digests = spark.createDataFrame(rows, "digest binary").repartition(7)
    found = {bytes(r.digest) for r in exact_dedup.frequent(digests, len(rows), 15).collect()}
    heavy = {d for d, n in Counter(r[0] for r in rows).items() if n > 2 * len(rows) / 16}
    assert heavy and heavy <= found and len(found) <= 16


def brute_fingerprint(text, size=3):
    import xxhash

    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = [w.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for w in words]
    grams = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_against_brute_force():
    rng = random.Random(1)
    texts = ["", None, "a", "A b", "x y z", "a a a a a", "É\x0bq\x0cr\r\ns", " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(500))]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def brute_components(fps, radius=3):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


@pytest.mark.parametrize("part", [4, 65_536])
def test_links_connect_what_brute_force_connects(spark, part):
    rng = random.Random(part)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(140):  # chains and dense clouds around some of them
        f = rng.choice(fps[:8] + fps[60:] if len(fps) > 60 else fps[:8])
        for b in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5)
    found = {r.node: r.root for r in components(simhash.hamming_links(distinct, 3, part)).collect()}
    roots = brute_components(fps)
    groups = {}
    for s, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(s)
    mine = {}
    for s in signed:
        mine.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert all(k == min(v) for k, v in mine.items())


def test_spanning_links_of_a_large_cloud():
    rng = random.Random(5)
    cloud = {0}
    while len(cloud) < 900:
        cloud.add(rng.choice(list(cloud)[:50]) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps = np.array(sorted(cloud), np.uint64)
    links = simhash.spanning_links(fps)
    assert len(links) < len(fps)
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in links)


def test_simhash_edges(docs):
    out = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(*EDGE)).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1)} <= out
    same = {r for r in out if r[0] in (4, 5, None)}
    assert len({r[1] for r in same}) == 1 and {r[2] for r in same} == {4}
    assert simhash.simhash_components(docs()).collect() == []


def test_near_dedup_keeps_one_of_each_group(docs):
    out = simhash.near_dedup(docs(*EDGE))
    assert out.columns == docs().columns
    assert sorted((r.doc_id for r in out.collect())) == [1, 4, 7, 8, 9]
    assert sorted(r.doc_id for r in simhash.near_dedup(docs((6, "q r s"), (6, "q r s"), (6, "entirely other words here"))).collect()) == [6, 6]
    assert simhash.near_dedup(docs()).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, text, _, host in rows:
        pages[host or ""] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            seen[host or "", line] += 1
    out = []
    for i, text, _, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not (seen[host or "", x.strip(" ")] >= least and seen[host or "", x.strip(" ")] / pages[host or ""] > ratio)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(docs):
    rng = random.Random(3)
    rows = [
        (i, "\n".join(rng.choice(["menu", " menu ", "foot", "", f"line {rng.randint(0, 30)}", f"own {i}"]) for _ in range(rng.randint(0, 8))), None, rng.choice(["a", "a", "b", None, ""]))
        for i in range(120)
    ] + [(900, None, None, "a"), (901, "", None, "b"), (901, "", None, "b")]
    out = line_dedup.line_dedup(docs(*rows), ratio=0.2, min_pages=4)
    assert set(docs().columns) < set(out.columns)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    assert got == brute_lines(rows, 0.2, 4)
    assert line_dedup.line_dedup(docs()).collect() == []


def test_line_dedup_leaves_small_hosts_alone(docs):
    rows = [(i, "same\nlines", None, "small") for i in range(line_dedup.MIN_PAGES - 1)]
    assert {r.n_dropped for r in line_dedup.line_dedup(docs(*rows)).collect()} == {0}
