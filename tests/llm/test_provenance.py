"""Kinds of files, and clusters of their shapes."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import provenance

HAND = "import os\n\n\ndef read(path, mode=None):\n    # opens it\n    with open(path) as f:\n        rows = [x.strip() for x in f if x]\n    if not rows:\n        return None\n    for r in rows:\n        print(f\"{r} row\")\n    return sorted(rows, key=len)\n"


def getters(seed, n=30):
    rng = random.Random(seed)
    return "".join(f"def get_{rng.choice('abc')}_{i}(msg):\n    return msg._fields[{rng.randint(1, 9999)}]\n\n" for i in range(n))


def kinds(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, repo string, content string").withColumn("kind", F.lit("clash"))
    return {r["file_path"]: r["kind"] for r in provenance.classify(df).collect()}


def test_kinds(spark):
    noted = "# Code generated by tool. DO NOT EDIT.\n" + HAND
    rows = [
        ("src/hand.py", "r", HAND),
        ("src/hand.py", "r", HAND),
        ("src/other.py", "r", HAND.replace("read", "load").replace("sorted", "reversed") + "\n\ndef more(a, b):\n    return {a: b}\n"),
        ("vendor/lib/x.py", "r", HAND.replace("path", "p")),
        ("vendors/x.py", "r", HAND.replace("path", "q")),
        ("src/a_pb2.py", "r", HAND.replace("path", "s")),
        ("src/noted.py", "r", noted),
        ("src/told.py", "r", "# Skips files marked as generated by a tool\n" + HAND.replace("path", "t")),
        ("src/string.py", "r", 'NOTICE = "DO NOT EDIT"\n' + HAND.replace("path", "v")),
        ("src/get1.py", "r", getters(1)),
        ("src/get2.py", "r", getters(2, 60)),
        ("src/rows.py", "r", "a,b,c\n" + "".join(f"{i},name,{i / 2}\n" for i in range(40))),
        ("src/blob.js", "r", 'module.exports = "' + "QUJD" * 100 + '";\n'),
        ("src/nums.rs", "r", "pub static T: &[u16] = &[\n" + "    1, 22, 333, 4444,\n" * 40 + "];\n"),
        ("src/packed.js", "r", "function d(q,F){return q+F*25};" * 40 + "\n"),
        ("src/banner.py", "r", 'BANNER = "' + "word and more words " * 40 + '"\n' + HAND.replace("path", "w")),
        ("src/none.py", None, None),
        ("src/empty.py", None, ""),
        (None, "r", HAND),
    ]
    got = kinds(spark, rows)
    assert got == {
        "src/hand.py": None, "src/other.py": None, "vendor/lib/x.py": "vendored", "vendors/x.py": None, "src/a_pb2.py": "generated", "src/noted.py": "generated", "src/told.py": None,
        "src/string.py": None, "src/get1.py": "generated", "src/get2.py": "generated", "src/rows.py": "data", "src/blob.js": "data", "src/nums.rs": "data", "src/packed.js": "minified",
        "src/banner.py": None, "src/none.py": None, "src/empty.py": None,
    }


def code(names, n=24):
    """A program that uses the names in a fixed pattern, each line of another form."""
    rng = random.Random(4)
    forms = ["{} = {}", "if {} > {}:", "{}({})", "return {}", "for {} in {}:", "{}.{}", "[{}, {}]", "{} + {}", "while {}:", "not {}", "{{{}: {}}}", "{} - {}", "import {}", "{}[{}]", "{} * {}", "@{}"]
    line = lambda: " ".join(rng.choice(forms).format(*rng.choices(names, k=2)) for _ in range(3))
    return "".join(line() + "\n" for _ in range(n))


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, repo string, content string")
    return {r["file_path"]: (r["kind"], r["own"], r["family"], r["copied"]) for r in provenance.classify(df).collect()}


def test_copies_between_repositories(spark):
    names, other, third = ([f"{p}{i}" for i in range(30)] for p in ("name", "word", "term"))
    swapped = other[:]
    swapped[3], swapped[11] = swapped[11], swapped[3]
    half = code(other).replace("word5", "word6")  # two names became one: no renaming
    got = verdicts(spark, [
        ("a/x.py", "r1", code(names)), ("b/x.py", "r2", code(swapped)), ("c/x.py", "r1", code(third)), ("d/x.py", "r3", half),
        ("a/short.py", "r1", "def f(a):\n    return a.b\n"), ("b/short.py", "r2", "def g(c):\n    return c.d\n"), ("a/hand.py", "r1", HAND), ("b/hand.py", "r2", HAND),
    ])
    copied, not_copied = ("vendored", None, None, True), (None, None, None, False)
    assert got == {
        "a/x.py": copied, "b/x.py": copied, "c/x.py": copied, "d/x.py": not_copied,
        "a/short.py": not_copied, "b/short.py": not_copied, "a/hand.py": copied, "b/hand.py": copied,
    }


def test_copies_within_one_repository_are_no_vendoring(spark):
    names, other = ([f"{p}{i}" for i in range(30)] for p in ("name", "word"))
    got = verdicts(spark, [("a/x.py", "r1", code(names)), ("b/x.py", "r1", code(other)), ("c/x.py", "r1", code(names))])
    assert set(got.values()) == {(None, None, None, False)}


def test_families_are_found_by_their_cluster_alone(spark):
    noted = "# Code generated by tool. DO NOT EDIT.\n"
    names = [[f"{p}{i}" for i in range(30)] for p in "pqrstuv"]
    rows = [(f"src/f{k}.py", "r", getters(k, 20 + 3 * k)) for k in range(4)]  # one template over and over
    rows += [("lone/f.py", "other", HAND)]
    rows += [(f"gen{k}.py", "r", noted + code(names[k])) for k in range(3)] + [("untold.py", "r", code(names[3]))]  # three of four are told
    rows += [(f"mixed{k}.py", "s", (noted if k else "") + code(names[k], 40)) for k in range(2)]  # one of two is told
    got = verdicts(spark, rows)
    assert all(got[f"src/f{k}.py"][:3] == ("generated", None, "generated") for k in range(4))
    assert got["untold.py"] == ("generated", None, "generated", False)
    assert got["gen0.py"][:2] == ("generated", "generated")
    assert got["lone/f.py"] == got["mixed0.py"] == (None, None, None, False) and got["mixed1.py"][0] == "generated"


def test_literals_are_found_by_their_cluster(spark):
    table = lambda n: "T = [\n" + "    1, 22, 333, 4444,\n" * n + "]\n"
    got = verdicts(spark, [("a.py", "r", table(20)), ("b.py", "r", table(30)), ("small.py", "r", table(3)), ("hand.py", "r", HAND)])
    assert got["small.py"] == ("data", None, "data", False) and got["a.py"][0] == got["b.py"][0] == "data"
    assert got["hand.py"][0] is None


def test_empty(spark):
    assert kinds(spark, []) == {}


def test_clusters_hold_together_and_miss_little(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(60)] for _ in range(4)]
    sets = {}
    for n in range(60):
        b = list(bases[n % 4])
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(60)] = rng.choice(words)
        sets[f"s{n:02}"] = np.unique(np.array([zlib.crc32(w.encode()) >> 1 for w in b], np.int32))
    rows = [(k, x.tolist(), provenance.bit_map(x), provenance.band_hashes(x)) for k, x in sets.items()] + [("none", [], [], [])]
    got = dict(map(tuple, provenance.shape_clusters(spark.createDataFrame(rows, "shape string, shingles array<int>, bits array<long>, bands array<long>")).collect()))
    sets = {k: set(x.tolist()) for k, x in sets.items()}
    assert set(got) == set(sets)
    jaccard = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    similar = [(x, y) for x, y in itertools.combinations(sets, 2) if jaccard(x, y) >= provenance.SIMILAR]
    # clusters are made of similar sets only, and hold all but what banding misses
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in similar:
        root[find(x)] = find(y)
    assert all(find(k) == find(c) for k, c in got.items())
    assert sum(got[x] == got[y] for x, y in similar) >= 0.97 * len(similar) > 100


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Few leaders and few hashes a band: buckets hold many components, and all their links must still be found."""
    monkeypatch.setattr(provenance, "LEADERS", 3)
    monkeypatch.setattr(provenance, "FIRST", 1)
    rng = random.Random(3)
    sets = {}
    for n in range(40):
        base = set(range(n % 8 * 6, n % 8 * 6 + 60))
        for x in rng.sample(sorted(base), rng.randint(0, 6)):
            base.discard(x)
        sets[f"s{n:02}"] = base
    rows = [(k, sorted(x), provenance.bit_map(np.array(sorted(x)) * 97), [1, 2 + n % 3]) for n, (k, x) in enumerate(sets.items())]
    got = dict(map(tuple, provenance.shape_clusters(spark.createDataFrame(rows, "shape string, shingles array<int>, bits array<long>, bands array<long>")).collect()))
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sets, 2):
        if len(sets[x] & sets[y]) >= provenance.SIMILAR * len(sets[x] | sets[y]):
            root[find(x)] = find(y)
    for x, y in itertools.combinations(sets, 2):
        assert (got[x] == got[y]) == (find(x) == find(y))
    assert len(set(got.values())) > 1


def test_near_and_short_copies_between_repositories(spark):
    long = "".join(HAND.replace("read", f"read{i}").replace("rows", f"rows{i}") for i in range(8))
    rows = [("a/x.py", "r1", long), ("b/x.py", "r2", long.replace("rows3", "lines")), ("c/x.py", "r1", HAND)]
    rows += [("a/s.py", "r1", "LIMIT = grow(3, by=tables)\n"), ("b/s.py", "r2", "LIMIT = grow(3, by=tables)\n"), ("c/s.py", "r2", "LIMIT = grow(4, by=rows)\n")]
    assert kinds(spark, rows) == {"a/x.py": "vendored", "b/x.py": "vendored", "c/x.py": None, "a/s.py": "vendored", "b/s.py": "vendored", "c/s.py": None}


def test_notices_below_long_headers(spark):
    header = "".join(f"# licence line {i}\n" for i in range(20))
    more = HAND.replace("read", "load") + "\n\nclass Rows:\n    pass\n" + HAND.replace("import os", "")
    rows = [
        ("src/late.py", "r", header + "\n# Code generated by tool. DO NOT EDIT.\n\n" + more),
        ("src/taken.rs", "r", "use a::b;\n" * 30 + "\n// Vendored from lib, tag v1.2\n\nfn f(x: u32) -> u32 {\n    x\n}\n" + "fn g() {}\n\n" * 8),
        ("src/doc.py", "r", header + "import os\n\n# This code is generated by the tool.\ndef f(a):\n    return a\n\n\n" + more),
        ("src/inner.py", "r", header + "def g(a):\n    # was generated by the tool\n    return [a]\n\n\n" + more),
    ]
    assert kinds(spark, rows) == {"src/late.py": "generated", "src/taken.rs": "vendored", "src/doc.py": None, "src/inner.py": None}
