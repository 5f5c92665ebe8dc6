import random
import re

import numpy as np

from quern.llm import components
from quern.llm import minhash as mh


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_force(rows, n=3, percent=85):
    sets, up = [(i, shingles(t, n)) for i, t in rows], {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [(i, len(s), None if i is None else root(i), i is not None and root(i) == i) for i, s in sets]


def make_rows():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(3000)]
    rows = [(None, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, " \n"), (5, "one"), (6, "ONE"), (7, "one two"), (8, "One Two"), (9, "x " * 4000)]
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([8, 20, 60, 200, 900]))
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((100 + len(rows), " ".join(words)))
    # a chain: neighbours are linked, ends are not
    words = rng.choices(vocab, k=150)
    for k in range(30):
        words = words[4:] + rng.choices(vocab, k=4)
        rows.append((1000 - k, " ".join(words)))
    return rows + [rows[20], (rows[21][0], "another text of the same id " * 3), (50, rows[25][1].upper()), (51, "One two Three four five six seven eight nine ten eleven twelve")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component string, id int").repartition(3)
    return sorted((tuple(r) for r in mh.clusters(df, **kw).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mh, "GROUP", 16)
    rows = make_rows()
    assert run(spark, rows) == sorted(brute_force(rows), key=str)
    assert run(spark, rows[:120], n=5, percent=80) == sorted(brute_force(rows[:120], 5, 80), key=str)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mh.clusters(df).count() == 0


def test_sketch_estimates_likeness():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.85, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : 2 * n - both]]))
        s = mh.sketches([a, b])
        assert (s > 0).all()
        assert abs(mh.likeness(s[:1], s[1:], np.array([n]), np.array([n]))[0] - j) < 4 * (j * (1 - j) / mh.REGISTERS) ** 0.5 + 0.01


def test_registers_keep_the_least_value():
    """Leading zeros and the bits after the first one, of hash * REGISTERS / 2**64 without its whole part."""
    rng = random.Random(8)
    for h in [0, 1, 5, 2**64 - 1, 2**63, *(rng.getrandbits(64) for _ in range(300)), *(rng.getrandbits(40) for _ in range(50))]:
        whole = h * mh.REGISTERS
        register, value = mh.placed(np.array([h], np.uint64))
        assert (int(register[0]), int(value[0])) == (whole >> 64, whole & (2**64 - 1))
        bits = f"{int(value[0]):064b}"
        zeros = min(62, len(bits) - len(bits.lstrip("0")))
        up = zeros + 1 if zeros < 62 else 62
        assert int(mh.pressed(value)[0]) == ((zeros + 1) << mh.MANTISSA) | int((bits[up:] + "0" * 64)[: mh.MANTISSA], 2)


def test_chance_collisions():
    """Unlike sets agree in as many registers as ``collisions`` says, within 10 %."""
    rng = np.random.default_rng(2)
    for n, m, k in ((20, 20, 420), (280, 280, 420), (280, 1500, 420), (4000, 4000, 330)):
        made = [mh.sketches([np.sort(rng.integers(0, 1 << 64, x, dtype=np.uint64)) for _ in range(k)]) for x in (n, m)]
        found = np.mean([(made[0][i] == made[1][j]).mean() for i in range(k) for j in range(k)])
        assert abs(found / mh.collisions(np.array([n]), np.array([m]))[0] - 1) < 0.1, (n, m)


def test_bands_rarely_miss():
    for percent in (80, 85, 90):
        bands, rows = mh.shape(percent)
        assert bands * rows <= mh.REGISTERS and (1 - (percent / 100) ** rows) ** bands < mh.MISS


def test_components_by_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 0)
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 301), (300, 301)] + [(500, k) for k in range(501, 530)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100, 300: 300, 301: 300, **dict.fromkeys(range(500, 530), 500)}


def test_smallest_sets_that_link(spark):
    """Six shingles within seven are 6 / 7 of the union; five within six are too few."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(1, " ".join(words[:8])), (2, " ".join(words[:9])), (3, " ".join(words[5:12])), (4, " ".join(words[5:11]) + " x y"), (5, "a b c d e f g"), (6, "a b c d e f g h")]
    got = run(spark, rows)
    assert got == sorted(brute_force(rows), key=str)
    assert [r[2] for r in got] == [1, 1, 3, 4, 5, 6]
    for percent in (50, 80, 85, 90, 99):
        least = mh.smallest_linked(percent)
        assert 100 * least >= percent * (least + 1) and (least == 1 or 100 * (least - 1) < percent * least)
