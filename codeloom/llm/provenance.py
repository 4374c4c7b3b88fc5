"""Generated, minified, vendored and data files among source files (problem 6).

Method: identifiers, numbers and strings are masked, and the files' token shingles are clustered by MinHash
banding, each candidate verified by its exact Jaccard similarity. Each cluster is then judged as a whole: a
family within a repository that repeats one template, or most of whose members are told to be a tool's work, is
generated; a cluster of literals is data; one of packed lines is minified; and within the clusters that reach
over several repositories, texts that agree (near copies, or copies with their names changed throughout) are
vendored. What a path or a notice says of its own file holds for that file besides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.prefilter import Finder, required
from codeloom.operators.graph import components
from codeloom.session import materialize

SHINGLE, BANDS, ROWS, SIMILAR = 5, 32, 8, 0.8
#: A family repeats its template: masked tokens to different masked shingles, on average over its members.
REPEATED = 8
#: Members that say that a tool wrote them: at least so many, and more than two thirds of their cluster.
TOLD = 3
#: Different names that a copy with changed names must agree in; with fewer, short texts agree by chance.
NAMES = 20
#: Characters from which a file of literals counts as data.
BLOB = 200
#: Sets of a bucket that are compared with all others of it in one round; if more are to be, the next rounds take them.
LEADERS, SALTS = 64, 16
#: Rounds in which a set is compared with one other of each of its buckets.
FIRST = 2
#: Bits of the maps that bound the common shingles of two sets.
BITS = 1024

#: Folders and file names that tools and package managers use.
VENDORED_PATH = (
    r"(^|/)(vendor|_vendor|node_modules|bower_components|third_party|third-party|thirdparty|site-packages|external|extern|deps)/"
)
GENERATED_PATH = (
    r"(_pb2?(_grpc)?\.(py|js|ts|go|rs)|\.pb\.(go|js|ts|rs)|[._-](gen|generated|autogen|g)\.\w+|_string\.go)$"
    r"|(^|/)(autogen|autogenerated|__generated__|generated|gen)/"
)
MINIFIED_PATH = r"[.-]min\.(js|mjs|cjs)$|\.bundle\.js$"

#: What generators and copied files say about themselves, on a comment line.
GENERATED_NOTICE = re.compile(
    r"(?i)\bdo not (?:edit|modify|change)\b(?!.{0,30}\bby hand\b.{0,30}\b(?:file|marker|comment|check))|<auto-?generated>|@generated\b|\bauto-?generated (?:by|from|file|code)\b"
    r"|\b(?:was|is|are) (?:automatically |auto-?)?generated\b|\bgenerated (?:automatically|by \w|from \w)|\bmachine-(?:made|generated)\b|\bmanual changes will be lost\b"
    r"|\b(?:edits|changes|modifications)\b.{0,20}\b(?:survive|lost|overwritten|dropped|discarded|reverted)\b.{0,30}\b(?:run|build|generat\w*|regenerat\w*|rebuil\w*|by|next)\b"
    r"|\bderived from \w+\.\w+ \(|\bregenerate (?:it )?with\b|\bthis (?:file|source|module|code) (?:is|was) (?:produced|written|emitted|rendered|created|built|made) by\b|\bnicht (?:bearbeiten|ändern)\b|\bno editar\b|\b(?:never edit|edit the spec instead|change the source, not this copy)\b"
    r"|\boutput of \w+ [\d.]+|\b\w+ (?:wrote|emitted|produced|rendered|created) this (?:\w+ )?(?:file|source|module|code)?\b.{0,40}\bfrom\b|\brerun the tool instead\b"
    r"|\b(?:emitted|written|produced) by \w+, [0-9a-f]{6,}|\bend of generated\b|\bgenerator checksum\b"
)
VENDORED_NOTICE = re.compile(
    r"(?i)\blocal patches: |\bunmodified (?:snapshot|copy|upstream)|\bbundled here\b|\bchecked in as released\b|\bv\d+(?:\.\d+)+ \| \(c\)|\(c\) \d{4} the \w+ team, released under\b"
    r"|\bthird[- ]party (?:code|source|library|package|module|component)\b|\bnot maintained here\b|\bsend (?:fixes|patches|changes|bugs) to the \w+ (?:maintainers|authors|project|team)\b"
    r"|^\W*(?:vendored|copied|synced|pulled|taken|imported|mirrored|forked|extracted|borrowed|cloned|snapshot|fetched)\b.{0,20}\b(?:from|of)\b.{0,40}\b(?:upstream|commit|tag|release|revision|version|project|repository|as a whole)\b"
    r"|^\W*(?:imported|vendored|verbatim|unchanged|bundled) copy of\b|\b(?:update|replace|resync|upgrade) as a whole\b|\bcopied (?:verbatim |unchanged )?from (?:the )?upstream\b"
)
BY_HAND = re.compile(r"(?i)\bwritten by hand\b|\bno tool rewrites\b|\bedit freely\b|^\W*(?:loads|skips|generates|finds|checks|lists|reads)\b")

#: Comments and strings in one pass, so that neither is looked for inside the other.
_PARTS = re.compile(
    r"(?P<c>\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#(?!\[)[^\n]*)|(?P<s>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)", re.S | re.M
)
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\\x[0-9a-fA-F]{2}|[^\w\s]")
_WORDS = re.compile(r"[^\W\d]\w*")
_KEEP = frozenset(
    "def return if for in import from class fn let pub use impl func package var const export function async None null nil true false struct mod self this else while match static not is range new throw".split()
)
_ROW = re.compile(r"\s*[\w.+-]+(?:(?:[,;\t|][^\n,;\t|(){}=]*){2,})?\s*$")
#: What a doc comment stands above.
_DECLARED = re.compile(r"\s*(?:@\w|#\[|(?:export|default|pub(?:\([^)]*\))?|async|abstract|static|unsafe|extern|declare)\s|(?:def|class|fn|func|function|type|struct|enum|impl|trait|interface|const|let|var|mod|macro_rules)\b)")

#: What marks a string in a text whose strings and comments are taken out.
_HOLE = "\u0001"
#: Derived from the patterns: each match of a notice has one of these.
_triggers = Finder(required(GENERATED_NOTICE) | required(VENDORED_NOTICE))

_RANDOM = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.zeros(0, np.uint64)

_SCHEMA = (
    "file_path string, repo string, shape long, text_key long, renamed_key long, shingles array<int>, bits array<long>, bands array<long>, text_bands array<long>,"
    " n_tokens int, n_shapes int, marked string, notice string, minified boolean, literal boolean"
)
_TYPES = {
    "shape": pa.int64(), "text_key": pa.int64(), "renamed_key": pa.int64(), "bits": pa.list_(pa.int64()), "shingles": pa.list_(pa.int32()), "bands": pa.list_(pa.int64()), "text_bands": pa.list_(pa.int64()),
    "n_tokens": pa.int32(), "n_shapes": pa.int32(), "minified": pa.bool_(), "literal": pa.bool_(),
}


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of 31 bits of the token shingles; of a shorter text one of all its tokens."""
    if not len(hashes):
        return np.zeros(0, np.int32)
    n = max(1, len(hashes) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(hashes))):
        out = out * _MIX + hashes[i : i + n]
    out ^= out >> np.uint64(29)
    return np.unique((out * _MIX >> np.uint64(33)).astype(np.int32))


def _key(hashes: np.ndarray) -> int:
    """A number for what the array holds."""
    return int.from_bytes(hashlib.md5(hashes.tobytes()).digest()[:8], "little", signed=True)


def bit_map(shingles: np.ndarray) -> list[int]:
    """The set's map of BITS bits, as longs."""
    bits = np.zeros(BITS, bool)
    bits[shingles & (BITS - 1)] = True
    return np.packbits(bits).view(np.int64).tolist()


def band_hashes(shingles: np.ndarray) -> list[int]:
    """A hash for each band of the MinHash signature of a shingle set; none for an empty set."""
    if not len(shingles):
        return []
    signature = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for s in range(0, len(shingles), 4096):
        part = shingles[s : s + 4096].astype(np.uint64)[:, None] * _MIX
        signature = np.minimum(signature, ((part ^ (part >> np.uint64(32))) * _RANDOM >> np.uint64(24)).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(31)
    return out.astype(np.int64).tolist()


def _parts(text: str) -> tuple[str, list[str], list[tuple[int, int]]]:
    """The text with a mark for each string and without comments; the strings; the places of the comments."""
    strings: list[str] = []
    comments: list[tuple[int, int]] = []

    def put(m: re.Match) -> str:
        if m["s"] is None:
            comments.append(m.span())
            return " "
        strings.append(m["s"])
        return f" {_HOLE} "

    return _PARTS.sub(put, text), strings, comments


def _plain(content: str) -> str:
    return content.replace("\r\n", "\n").replace(_HOLE, " ")


def _text_hashes(tokens: list[str], of: dict[str, int], strings: list[str]) -> np.ndarray:
    """A hash for each token of the unmasked text, a string being one token."""
    if not tokens:
        return _EMPTY
    out = np.fromiter((of[t] for t in tokens), np.uint64, len(tokens))
    if strings:
        at = [i for i, t in enumerate(tokens) if t == _HOLE]
        out[at] = [xxhash.xxh64_intdigest(s) for s in strings]
    return out


def text_shingles(content: str) -> tuple[int, np.ndarray]:
    """(key, shingles) of the unmasked tokens of a text, comments aside."""
    bare, strings, _ = _parts(_plain(content))
    tokens = _TOKEN.findall(bare)
    hashes = _text_hashes(tokens, {t: xxhash.xxh64_intdigest(t) for t in set(tokens)}, strings)
    return _key(hashes), _grams(hashes)


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a comment begins a line without indentation and documents no declaration below its block."""
    if text[start] in " \t" or start and text[start - 1] != "\n":
        return False
    while True:
        stop = text.find("\n", end)
        if stop < 0:
            return True
        line = text[stop + 1 : end] if (end := text.find("\n", stop + 1)) >= 0 else text[stop + 1 :]
        if end < 0 or not line.lstrip().startswith(("//", "/*", "*", "# ", "#!")) and line.strip() != "#":
            return not _DECLARED.match(line)


def own_notice(text: str, comments: list[tuple[int, int]]) -> str:
    """What a text says about itself: generated, vendored or nothing.

    Looked for in all comments: those before the first and behind the last line of code, and those in
    between that stand alone; a comment beside or above a declaration is about that.
    """
    told = ""
    lead, last = 0, len(text.rstrip())
    for start, end in comments:
        if text[lead:start].strip():
            break
        lead = end
    for start, end in reversed(comments):
        if text[end:last].strip():
            break
        last = start
    for start, end in comments:
        comment = text[start:end]
        if not _triggers(comment) or not (GENERATED_NOTICE.search(comment) or VENDORED_NOTICE.search(comment)):
            continue
        if not (end <= lead or start >= last or _stands_alone(text, start, end)):
            continue
        for line in comment.split("\n"):
            if BY_HAND.search(line):
                continue
            if GENERATED_NOTICE.search(line):
                told = "generated"
            elif VENDORED_NOTICE.search(line):
                told = told or "vendored"
    return told


def _is_literal(text: str, bare: str, lines: list[str], strings: list[str]) -> bool:
    """Numbers, strings, rows of values or bytes; at most a declaration's words around them."""
    if len(text.strip()) < BLOB:
        return False
    if not lines:
        return len(text.strip()) >= 2 * BLOB
    solid = len(re.sub(r"\s*\u0001\s*", "", bare).strip()) + sum(map(len, strings))
    longest = max((len(x) for part in (bare, *strings) for x in re.findall(rf"[\w+/=-]{{{BLOB},}}", part)), default=0)
    if longest >= 0.5 * solid > 0 or len(lines) >= 8 and sum(bool(_ROW.match(x)) for x in lines) >= 0.9 * len(lines):
        return True
    words = [w for w in _WORDS.findall(re.sub(r"\\x[0-9a-fA-F]{2}", " ", bare))]
    return len(words) <= 12 and len(re.sub(r"\W", "", _WORDS.sub("", bare))) + sum(map(len, strings)) + 3 * bare.count("\\x") >= 0.5 * solid


def file_profile(path: str, content: str) -> dict:
    """What is clustered of a file (masked and unmasked shingles by their MinHash bands), and what it tells by itself."""
    text = _plain(content)
    bare, strings, comments = _parts(text)
    tokens = _TOKEN.findall(bare)
    kinds = set(tokens)
    is_name = {t for t in kinds if t not in _KEEP and (t[0].isalpha() or t[0] == "_")}
    of = {t: xxhash.xxh64_intdigest(t) for t in kinds}
    mask = {t: 1 if t in is_name else 2 if t == _HOLE else 3 if t[0].isdigit() or t[0] == "\\" else of[t] for t in kinds}
    masked = np.fromiter((mask[t] for t in tokens), np.uint64, len(tokens))
    shingles = _grams(masked)
    hashes = _text_hashes(tokens, of, strings)
    # names numbered as they first come: equal for copies whose names were changed throughout
    renamed = None
    if len(is_name) >= NAMES:
        number: dict[str, int] = {}
        renamed = masked.copy()
        at = [i for i, t in enumerate(tokens) if t in is_name]
        renamed[at] = [number.setdefault(tokens[i], len(number)) + 16 for i in at]
    marked = "vendored" if re.search(VENDORED_PATH, path) else "generated" if re.search(GENERATED_PATH, path) else "minified" if re.search(MINIFIED_PATH, path) else ""
    lines = [x for x in bare.split("\n") if x.strip()]
    packed = "".join(x for x in lines if len(x) > 400)
    minified = len(packed) > 0.5 * sum(map(len, lines)) and packed.count(" ") < 0.15 * len(packed) and len(re.findall(r"[;{}()=]", packed)) > 0.05 * len(packed)
    return {
        "shape": _key(shingles) if len(shingles) else None,
        "text_key": _key(hashes) if len(hashes) else None,
        "renamed_key": _key(renamed) if renamed is not None else None,
        "shingles": shingles,
        "bits": bit_map(shingles),
        "bands": band_hashes(shingles),
        "text_bands": band_hashes(_grams(hashes)),
        "n_tokens": len(tokens),
        "n_shapes": len(shingles),
        "marked": marked,
        "notice": own_notice(text, comments),
        "minified": bool(minified),
        "literal": _is_literal(text, bare, lines, strings),
    }


def profiles(source_files: DataFrame) -> DataFrame:
    """file_profile of each row; rows without path are left out, null content is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            rows = [{"file_path": p, "repo": r} | file_profile(p, c or "") for p, r, c in zip(*(batch.column(i).to_pylist() for i in range(3))) if p is not None]
            yield from pa.table({n: pa.array([r[n] for r in rows], _TYPES.get(n, pa.string())) for n in names}).to_batches()

    return source_files.select("file_path", "repo", "content").mapInArrow(run, _SCHEMA)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets have an exact Jaccard similarity of SIMILAR or more.

    The sizes and bit maps bound the common shingles from above: those in one bit of the left map count as one
    there, so what its bits fall short of its size is added. Only pairs that pass this are joined to their shingles.
    """
    of = lambda end, *columns: sets.select(F.col("shape").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    sized = pairs.join(of("a", "bits", "n"), "a").join(of("b", "bits", "n"), "b")
    count = lambda x: sum((F.bit_count(x(i)).cast("int") for i in range(1, BITS // 64)), F.bit_count(x(0)).cast("int"))
    common = count(lambda i: F.col("a_bits")[i].bitwiseAND(F.col("b_bits")[i])) + F.col("a_n") - count(lambda i: F.col("a_bits")[i])
    common = F.least(common, "a_n", "b_n")
    near = sized.where(common >= SIMILAR * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    exact = near.join(of("a", "shingles"), "a").join(of("b", "shingles"), "b")
    return exact.where(common >= SIMILAR * (F.size("a_shingles") + F.size("b_shingles") - common)).select("a", "b")


def shape_clusters(sets: DataFrame) -> DataFrame:
    """(shape, cluster) for distinct sets (shape, shingles, bits, bands): the components of the links between similar sets.

    Sets that share a band hash are in one bucket. In FIRST rounds each set is compared with one set of the largest
    component of each of its buckets; that connects most of them. After that, of each bucket that still holds
    several components, the sets outside its largest one (of more than LEADERS so many of them) are compared with
    the others of the bucket, and leave it; this goes on until every bucket is one component or used up. So any two
    sets of a bucket were compared or are connected by others: only what shares no bucket at all is lost. Pairs
    grow with a bucket, not with its square, and only ids move; rows of a hot bucket are spread over SALTS.
    """
    sets = sets.where(F.size("shingles") > 0).withColumn("n", F.size("shingles"))
    of = sets.select("shape", F.col("shape").alias("component")).where("false")
    left = materialize(sets.select("shape", F.explode("bands").alias("bucket")))
    round_ = 0
    while not left.isEmpty():
        placed = left.join(of, "shape", "left").withColumn("component", F.coalesce("component", "shape"))
        draw = F.xxhash64("shape", "bucket", F.lit(round_))
        counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min_by("shape", draw).alias("one"))
        several = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "component", "one")).alias("top"), F.sum("n").alias("n"))
        several = several.where("k > 1").select("bucket", F.col("top.component").alias("largest"), "top.one", (F.col("n") - F.col("top.n")).alias("outside"))
        placed = materialize(placed.join(several, "bucket"))
        if round_ < FIRST:
            pairs = placed.where("component <> largest").select(F.least("shape", "one").alias("a"), F.greatest("shape", "one").alias("b")).distinct()
            left = placed.select("bucket", "shape")
        else:
            outside = placed.where("component <> largest").select("bucket", F.col("shape").alias("leader"), F.col("component").alias("of_leader"), "outside")
            part = F.pmod(F.xxhash64("leader", F.lit(7)), F.lit(LEADERS)).alias("part")
            some = outside.where(F.col("outside") > LEADERS).groupBy("bucket", part).agg(F.min(F.struct("leader", "of_leader")).alias("l"))
            leaders = outside.where(F.col("outside") <= LEADERS).select("bucket", "leader", "of_leader").unionByName(some.select("bucket", "l.leader", "l.of_leader"))
            leaders = materialize(leaders)
            spread = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = placed.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).cast("int"))
            pairs = salted.join(spread, ["bucket", "salt"]).where("component <> of_leader")
            pairs = pairs.select(F.least("shape", "leader").alias("a"), F.greatest("shape", "leader").alias("b")).distinct()
            led = leaders.select("bucket", F.col("leader").alias("shape"))
            left = materialize(placed.where(F.col("outside") > LEADERS).select("bucket", "shape").join(led, ["bucket", "shape"], "left_anti"))
        links = materialize(_verified(pairs, sets))
        if not links.isEmpty():
            # the components so far are the nodes that the new links join
            root = lambda end: F.coalesce(F.col(f"{end}_root"), F.col(end)).alias(end)
            named = links.join(of.select(F.col("shape").alias("a"), F.col("component").alias("a_root")), "a", "left")
            named = named.join(of.select(F.col("shape").alias("b"), F.col("component").alias("b_root")), "b", "left")
            joined = materialize(components(named.select(root("a"), root("b"))))
            moved = of.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
            moved = moved.select("shape", F.coalesce("now", "component").alias("component"))
            new = joined.select(F.col("id").alias("shape"), "component").join(of.select("shape"), "shape", "left_anti")
            of = materialize(moved.unionByName(new))
        round_ += 1
    alone = sets.select("shape", F.col("shape").alias("cluster")).join(of.select("shape"), "shape", "left_anti")
    return of.select("shape", F.col("component").alias("cluster")).unionByName(alone)


def near_texts(source_files: DataFrame, files: DataFrame) -> DataFrame:
    """(shape, shingles, bits, bands): the unmasked texts that share a band with another text of another repository.

    They are read again, one file for each different text.
    """
    texts = files.where("text_key is not null").select("file_path", F.coalesce("repo", F.lit("")).alias("r"), "text_key", "text_bands")
    of_bands = texts.select("text_key", "r", F.explode("text_bands").alias("bucket"))
    shared = of_bands.groupBy("bucket").agg(F.min("r").alias("l"), F.max("r").alias("h"), F.min("text_key").alias("k"), F.max("text_key").alias("m"))
    near = of_bands.join(shared.where("l <> h and k <> m").select("bucket"), "bucket", "left_semi").select("text_key").distinct()
    one = texts.join(near, "text_key", "left_semi").groupBy("text_key").agg(F.min(F.struct("file_path", "r")).alias("one")).select("one.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_shingles(c or "") for c in batch.column(0).to_pylist()]
            cols = {"shape": [k for k, _ in found], "shingles": [s for _, s in found], "bits": [bit_map(s) for _, s in found], "bands": [band_hashes(s) for _, s in found]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, _TYPES[k]) for k, v in cols.items()})

    again = source_files.select("file_path", F.coalesce("repo", F.lit("")).alias("r"), "content").join(one, ["file_path", "r"], "left_semi")
    return again.select("content").mapInArrow(run, "shape long, shingles array<int>, bits array<long>, bands array<long>")


def classify(source_files: DataFrame) -> DataFrame:
    """(file_path, repo, cluster, kind, own, family, copied, ...): kind is generated, minified, vendored, data or null (hand-written).

    ``family`` is what the file's cluster was judged to be, ``copied`` whether its text agrees with one of another
    repository, ``own`` what its path, notice or form says; kind is the first of vendored, minified, generated and data
    that any of them says, the family's only where the file's own says nothing. Repeated rows are one
    file. Empty and null content is hand-written unless the path says otherwise; a null repo is a repository of its
    own; an empty table gives no rows; extra columns are ignored.
    """
    files = materialize(profiles(source_files).dropDuplicates(["file_path", "repo", "shape", "text_key"]))
    masked = files.where("shape is not null").groupBy("shape").agg(*[F.first(c).alias(c) for c in ("shingles", "bits", "bands")])
    # masked sets get even numbers, unmasked ones odd ones
    tag = lambda key, odd: F.shiftleft(key, 1) + F.lit(odd)
    texts = near_texts(source_files, files).dropDuplicates(["shape"])
    sets = materialize(masked.withColumn("shape", tag("shape", 0)).unionByName(texts.withColumn("shape", tag("shape", 1))))
    clusters = materialize(shape_clusters(sets))
    own = (
        F.when((F.col("marked") == "vendored") | (F.col("notice") == "vendored"), "vendored")
        .when(F.col("minified") | (F.col("marked") == "minified"), "minified")
        .when((F.col("marked") == "generated") | (F.col("notice") == "generated"), "generated")
        .when(F.col("literal"), "data")
    )
    of_shape = clusters.where("shape % 2 = 0").withColumnRenamed("shape", "set")
    members = files.drop("shingles", "bits", "bands", "text_bands").withColumn("set", tag("shape", 0)).withColumn("own", own).withColumn("r", F.coalesce("repo", F.lit("")))
    members = materialize(members.join(of_shape, "set", "left").drop("set"))

    # clusters are judged by counts, taken per repository first
    per_repo = members.where("cluster is not null").groupBy("cluster", "r").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("n_tokens") / F.col("n_shapes")).alias("repeats"),
        *[F.sum(F.coalesce(F.col("own") == k, F.lit(False)).cast("int")).alias(k) for k in ("generated", "minified")],
        F.sum(F.col("literal").cast("int")).alias("data"),
    )
    judged = per_repo.groupBy("cluster").agg(F.max("n").alias("in_repo"), *[F.sum(c).alias(c) for c in ("n", "repeats", "generated", "minified", "data")])
    told = lambda c: (F.col(c) >= TOLD) & (3 * F.col(c) > 2 * F.col("n"))
    family = (
        F.when(2 * F.col("data") > F.col("n"), "data")
        .when(told("minified"), "minified")
        .when(told("generated") | (F.col("in_repo") >= 2) & (F.col("repeats") >= REPEATED * F.col("n")), "generated")
    )
    judged = judged.select("cluster", family.alias("family"), (F.col("in_repo") < F.col("n")).alias("wide")).where("family is not null or wide")

    # of the clusters over several repositories, the texts that agree beyond the mask
    of_text = clusters.where("shape % 2 <> 0").select(F.col("shape").alias("text"), F.col("cluster").alias("text_cluster"))
    members = members.join(judged, "cluster", "left").withColumn("text", tag("text_key", 1)).join(of_text, "text", "left")
    members = materialize(members.withColumn("text_cluster", F.coalesce("text_cluster", "text")))
    wide = members.where("wide")

    def agreeing(key: str, flag: str) -> DataFrame:
        # counted per key and repository first: a text that a third of all files hold is one row a map task
        reach = wide.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("r").alias("low"), F.max("r").alias("high"))
        return reach.where("low <> high").select(key, F.lit(True).alias(flag))

    members = members.join(agreeing("text_cluster", "copied"), "text_cluster", "left").join(agreeing("renamed_key", "renamed"), "renamed_key", "left")
    copied = F.coalesce("copied", "renamed", F.lit(False))
    kind = F.coalesce("own", "family", F.when(copied, "vendored"))
    return members.select("file_path", "repo", "cluster", kind.alias("kind"), "own", "family", copied.alias("copied"), "marked", "notice", "n_tokens", "n_shapes")
