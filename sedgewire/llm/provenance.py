"""Generated, minified, vendored and blob files: belief propagation over directory trees.

A file's own evidence (path, leading comments, shape of its symbols' bodies) is
combined with that of its siblings of the same kind of name and with its
directory's, which in turn is what its files and its parent and child
directories make likely. The tree of a repository has a node for every
directory, for every kind of name in a directory, and for every path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.runtime import cut, scan_distinct_text, store

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Chance of a file's label given that of its siblings (rows), in the order of LABELS; of the siblings' given their directory's; and of a
#: directory's given its parent's, if its name says nothing. A directory whose name says what it holds tells nothing about its parent and depends
#: on it no more than a file.
FILE_COMPATIBILITY = (
    (0.88, 0.03, 0.03, 0.03, 0.03),
    (0.05, 0.88, 0.02, 0.02, 0.03),
    (0.08, 0.03, 0.84, 0.03, 0.02),
    (0.03, 0.02, 0.04, 0.89, 0.02),
    (0.10, 0.04, 0.02, 0.02, 0.82),
)
SIBLING_COMPATIBILITY = tuple(tuple(0.96 if i == j else 0.01 for j in range(5)) for i in range(5))
DIRECTORY_COMPATIBILITY = ((0.996, 0.001, 0.001, 0.001, 0.001), *SIBLING_COMPATIBILITY[1:])
#: Natural logarithms of likelihood ratios: a directory's name that says what it holds (also that a repository's root is handwritten), a telling
#: sign, a hint, and for handwritten: a body without any sign (which third parties write as well), a path alone without any.
NAMED, SIGN, HINT, PLAIN_BODY, PLAIN_PATH = 14.0, 9.0, 4.0, 1.2, 0.5
#: Directories of the deepest levels that one task takes at once; the levels above are a job each.
BLOCK_DIRECTORIES = 20_000
#: Characters from which a body can be told to be data, and a line to be minified (one below 200 must be most of its body).
LEAST_DATA, LEAST_LINE = 120, 120

# Wordings that tools put into the leading comment of a file.
_GENERATED_NOTE = re.compile(
    r"(?i)\bcode generated by\b|@generated\b|<auto-?generated\b|\bauto-?generated(?: (?:file|code|by|from)\b|:)|^\W*(?:this (?:file|code|class|module) (?:was|is|has been) )(?:\w+ )?(?:auto(?:matically)?[- ]?)?(?:generated|produced automatically)|"
    r"\bgenerated (?:by|from|with|using) (?:the )?[\w./-]+[ ,(]*(?:v(?:ersion)?\.? ?\d|\d+\.\d|compiler|from|on \d)|\bdo not (?:edit|modify|change)(?: this file)?(?: by hand| manually|[.;!*/ -]*$|; source)|\bmanual changes will be lost|\boutput of [\w.-]+ on [\w./-]+|maschinell erzeugt|nicht von hand bearbeiten|généré automatiquement|generado automáticamente|自动生成|自動生成"
)
_VENDORED_NOTE = re.compile(
    r"(?i)\bvendored (?:copy|from|version)\b|\bcopied (?:unmodified|verbatim|without changes) from\b|\bthird[- ]party (?:source|code|library)\b|\bdistributed under the\b.{0,40}licen[sc]e|\(c\) .{1,60}\bcontributors\b|\bmit license\b|@license\b|\bupstream: https?://|^\W*[\w.-]+ v?\d+\.\d+\.\d+ (?:[|-]|\(c\))"
)
_HAND_NOTE = re.compile(r"(?i)\bhand[- ]?written\b|\bwritten by hand\b")
_GENERATED_NAME = re.compile(r"(?i)(?:\.(?:g|gen|generated|designer|freezed)\.\w+|\.pb(?:\.gw)?\.\w+|_pb2?(?:_grpc)?\.\w+|[._]generated\.\w+|^zz_generated.*|[._-]autogen(?:erated)?\.\w+)$")
_MINIFIED_NAME = re.compile(r"(?i)(?:[.-]min\.\w+|\.(?:bundle|chunk|umd|iife)\.\w+|(?:^|[._-])bundle\.(?:js|mjs|css)|\.(?:js|css|mjs)\.map)$")
_HASHED_NAME = re.compile(r"[.-](?=[0-9a-f]*\d)[0-9a-f]{8,20}\.(?:js|mjs|cjs|css)$")
_COMMENT = re.compile(r"\s*(?:(?://|#(?!!)|--)[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|<!--.*?-->)", re.S)
_SHEBANG = re.compile(r"\s*#![^\n]*\n")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
_DATA = re.compile(r"(?:(?:-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|\"(?:\\x[0-9a-fA-F]{2}|[A-Za-z0-9+/=]){24,}\"|'(?:\\x[0-9a-fA-F]{2}|[A-Za-z0-9+/=]){24,}')\s*,\s*){6,}(?:-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)|[\"'][A-Za-z0-9+/=\\x]*[\"'])?")
_LONG_TEXT = re.compile(r"[A-Za-z0-9+/=]{48,}")


def body_signs(body: str) -> list[tuple]:
    """[(sign,)] of a symbol's body: generated, minified, vendored, blob, hand or plain."""
    at = _SHEBANG.match(body)
    at = at.end() if at else 0
    notes = []
    while m := _COMMENT.match(body, at):
        notes.append(m[0])
        at = m.end()
    note = "\n".join(notes)
    lines = re.split(r"\n", note)
    out = []
    if any(_GENERATED_NOTE.search(x) for x in lines):
        out.append("generated")
    if any(_VENDORED_NOTE.search(x) for x in lines):
        out.append("vendored")
    code = body[at:]
    n = len(code)
    if n >= LEAST_DATA:
        data = sum(m.end() - m.start() for m in _DATA.finditer(code))
        if data < 0.6 * n:
            data = max(data, sum(m.end() - m.start() for m in _LONG_TEXT.finditer(code))) if code.count("(") < 3 else data
        if data >= 0.6 * n:
            out.append("blob")
        elif any(len(x) >= LEAST_LINE for x in code.split("\n")):
            bare = _STRINGS.sub('""', re.sub(r"(?m)(?<!:)//[^\n]*$|/\*(?:[^*]|\*(?!/))*\*/", "", code))
            for x in bare.split("\n"):
                if (len(x) >= 200 or len(x) >= LEAST_LINE and len(x) >= 0.8 * len(bare)) and x.count(" ") <= 0.12 * len(x) and sum(x.count(c) for c in ";,{}()=") >= 0.06 * len(x):
                    out.append("minified")
                    break
    if not out:
        out.append("hand" if _HAND_NOTE.search(body) else "plain")
    return [(x,) for x in out]


# Names of directories by what they hold, and those whose children are packages of others.
_VENDORED_DIRS = frozenset("node_modules bower_components jspm_packages site-packages third_party third-party thirdparty pods carthage".split())
_GENERATED_DIRS = frozenset("generated __generated__ generated-sources generated-src autogen autogenerated gen-src".split())
_PACKAGE_DIRS = frozenset("vendor external deps extern ext libs contrib dependencies".split())
_VERSIONED = re.compile(r"[a-z][\w-]*[-_.@]v?\d+([._]\d+)+")


def directory_evidence(path: str) -> list[float]:
    """Log evidence that a directory's name and its parent's give, by label; a root is handwritten."""
    if not path:
        return [NAMED, 0.0, 0.0, 0.0, 0.0]
    up, _, name = path.lower().rpartition("/")
    up = up.rpartition("/")[2]
    version, package = bool(_VERSIONED.fullmatch(name)), up in _PACKAGE_DIRS
    vendored = NAMED if name in _VENDORED_DIRS or version and package or up == "vendor" else SIGN if version or package else HINT if name == "vendor" else 0.0
    generated = NAMED if name in _GENERATED_DIRS or (up, name) == ("migrations", "auto") else SIGN if name == "dist" else HINT if name == "gen" else 0.0
    return [0.0, generated, 0.0, vendored, 0.0]


def _sum(terms: np.ndarray) -> np.ndarray:
    """Logarithm of the sums over the last axis."""
    top = terms.max(axis=-1, keepdims=True)
    return top[..., 0] + np.log(np.exp(terms - top).sum(axis=-1))


def to_parent(belief: np.ndarray, chances: tuple) -> np.ndarray:
    return _sum(belief[:, None, :] + np.log(chances)[None])


def to_child(belief: np.ndarray, chances: tuple) -> np.ndarray:
    return _sum(belief[:, None, :] + np.log(chances).T[None])


def _matrix(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    return np.stack([batch.column(f"{prefix}{i}").to_numpy(zero_copy_only=False) for i in range(5)], axis=1)


def _fields(prefix: str) -> str:
    return ", ".join(f"{prefix}{i} double" for i in range(5))


def _with(batch: pa.RecordBatch, keep: list[str], **matrices: np.ndarray) -> pa.RecordBatch:
    arrays = [batch.column(c) for c in keep] + [pa.array(m[:, i]) for m in matrices.values() for i in range(5)]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f"{p}{i}" for p in matrices for i in range(5))])


def _sums(df: DataFrame, keys: list[str], prefix: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(f"{prefix}{i}").alias(f"{out}{i}") for i in range(5)])


def _messages(df: DataFrame, keep: list[str], prefix: str, chances: tuple) -> DataFrame:
    """``keep``, the beliefs, and the messages u to the parent."""
    schema = ", ".join([f"{c} string" for c in keep] + [_fields(prefix), _fields("u")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _matrix(batch, prefix)
            yield _with(batch, keep, **{prefix: b, "u": to_parent(b, chances)})

    return df.select(*keep, *_vector(prefix)).mapInArrow(run, schema)


_DIRS = f"tree string, dir string, up string, level int, {_fields('b')}, {_fields('u')}"


def _upward(rows: list[tuple[str, str]], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of directories from below, and their messages to their parents; a telling name sends none."""
    own = np.array([directory_evidence(d) for _, d in rows])
    b = sums + own
    u = to_parent(b, DIRECTORY_COMPATIBILITY)
    u[(own[:, 1:] > 0).any(axis=1)] = 0.0
    return b, u


def _downward(rows: list[tuple[str, str]], above: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Messages of the parents' whole beliefs to directories."""
    telling = np.array([max(directory_evidence(d)[1:]) > 0 for _, d in rows])[:, None]
    return np.where(telling, to_child(above - u, FILE_COMPATIBILITY), to_child(above - u, DIRECTORY_COMPATIBILITY))


def _depth(path: str) -> int:
    return path.count("/") + 1 if path else 0


def _up_levels(least: int):
    """An Arrow function that takes all directories of its task upward, level by level, down to level ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, dict[tuple[str, str], np.ndarray]] = {}
        for batch in batches:
            for tree, path, m in zip(batch.column("tree").to_pylist(), batch.column("dir").to_pylist(), _matrix(batch, "m")):
                level = sums.setdefault(_depth(path), {})
                level[tree, path] = level.get((tree, path), 0.0) + m
        for depth in range(max(sums, default=-1), least - 1, -1):
            rows = list(sums.get(depth, ()))
            if not rows:
                continue
            b, u = _upward(rows, np.array([sums[depth][r] for r in rows]))
            ups = [d.rpartition("/")[0] for _, d in rows]
            for (tree, _), up, m in zip(rows, ups, u) if depth > least else ():
                level = sums.setdefault(depth - 1, {})
                level[tree, up] = level.get((tree, up), 0.0) + m
            arrays = [[t for t, _ in rows], [d for _, d in rows], ups, np.full(len(rows), depth, np.int32), *b.T, *u.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a) if isinstance(a, np.ndarray) else a) for a in arrays], names=["tree", "dir", "up", "level", *(f"{p}{i}" for p in "bu" for i in range(5))])

    return run


def _down_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole beliefs of all directories of a task, level by level; those without a parent there have it as p, roots have none."""
    levels: dict[int, list] = {}
    for batch in batches:
        for tree, path, up, level, b, u, p in zip(*(batch.column(c).to_pylist() for c in ("tree", "dir", "up", "level")), *(_matrix(batch, x) for x in "bup")):
            levels.setdefault(level, []).append(((tree, path), (tree, up), b, u, p))
    whole: dict[tuple[str, str], np.ndarray] = {}
    for depth in sorted(levels):
        rows, ups, b, u, p = zip(*levels[depth])
        above = np.array([whole.get(up, given) for up, given in zip(ups, p)])
        full = np.array(b)
        if depth:
            full = full + _downward(list(rows), above, np.array(u))
        whole |= dict(zip(rows, full))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([d for _, d in rows]), *(pa.array(np.ascontiguousarray(c)) for c in full.T)], names=["tree", "dir", *(f"p{i}" for i in range(5))])


def _vector(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(5)]


def _parent(path: str) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def file_evidence(files: DataFrame, signs: DataFrame) -> DataFrame:
    """(tree, path, e0..e4): log evidence of every path by label, over all its versions."""
    name = F.element_at(F.split("path", "/"), -1)
    rx = lambda p: name.rlike(p.pattern)
    has = lambda s: F.coalesce(F.array_contains("signs", s), F.lit(False))
    by_path = files.join(signs, "file_id", "left").groupBy("tree", "path").agg(F.array_distinct(F.flatten(F.collect_set("signs"))).alias("signs"))
    in_dist = F.col("path").rlike(r"(?i)(^|/)(dist|build|public|assets|static)/")
    score = lambda c, v: F.when(c, v).otherwise(0.0)
    return by_path.select(
        "tree",
        "path",
        F.when(has("hand"), HINT).when(F.size("signs") == 0, PLAIN_PATH).when(has("plain") & (F.size("signs") == 1), PLAIN_BODY).otherwise(0.0).alias("e0"),
        (score(has("generated"), SIGN + 3) + score(rx(_GENERATED_NAME), SIGN)).alias("e1"),
        (score(has("minified"), SIGN + 3) + score(rx(_MINIFIED_NAME), SIGN) + score(rx(_HASHED_NAME), F.when(in_dist, SIGN).otherwise(HINT))).alias("e2"),
        (score(has("vendored"), SIGN + 3) + score(has("plain") & (F.size("signs") == 1), PLAIN_BODY)).alias("e3"),
        score(has("blob"), SIGN + 3).alias("e4"),
    )


def propagate(evidence: DataFrame, block: int = BLOCK_DIRECTORIES) -> DataFrame:
    """(tree, path, label): most likely label of every path after one upward and one downward pass.

    The deepest levels that hold no more than ``block`` directories in all are
    one task each way, every level above is one aggregation or join; nodes are
    keyed by (tree, directory), so a large tree is spread like any other rows.
    """
    kind = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^[^.]*(.*)$", 1))
    base = store(_messages(evidence.select("tree", "path", _parent("path").alias("dir"), kind.alias("kind"), *_vector("e")), ["tree", "path", "dir", "kind"], "e", FILE_COMPATIBILITY))
    siblings = store(_messages(_sums(base, ["tree", "dir", "kind"], "u", "b"), ["tree", "dir", "kind"], "b", SIBLING_COMPATIBILITY))
    level = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    leaves = store(_sums(siblings, ["tree", "dir"], "u", "m").withColumn("level", level))
    held = dict(leaves.groupBy("level").count().collect())  # one row per level
    least, below, total = max(held, default=0) + 1, 0, 0
    while least and total + below + held.get(least - 1, 0) <= block:
        least -= 1
        below += held.get(least, 0)
        total += below
    dirs = [store(leaves.where(F.col("level") >= least).select("tree", "dir", *_vector("m")).repartition(1).mapInArrow(_up_levels(least), _DIRS))]
    for depth in range(least - 1, -1, -1):
        above = dirs[-1].where(F.col("level") == depth + 1).select("tree", F.col("up").alias("dir"), *[F.col(f"u{i}").alias(f"m{i}") for i in range(5)])
        own = leaves.where(F.col("level") == depth).select("tree", "dir", *_vector("m"))
        dirs.append(store(_sums(own.unionByName(above), ["tree", "dir"], "m", "m").mapInArrow(_up_levels(depth), _DIRS)))
    whole_schema = f"tree string, dir string, {_fields('p')}"
    no_parent = [F.lit(0.0).alias(f"p{i}") for i in range(5)]
    whole, full = [], None
    for at in reversed(dirs):
        if full is None:
            given = at.select("*", *no_parent)
        else:
            given = at.join(full.withColumnRenamed("dir", "up"), ["tree", "up"], "left").select(*at.columns, *[F.coalesce(f"p{i}", F.lit(0.0)).alias(f"p{i}") for i in range(5)])
        full = store((given.repartition(1) if at is dirs[0] else given).mapInArrow(_down_levels, whole_schema))
        whole.append(full)
    beliefs = reduce(DataFrame.unionByName, whole)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = _matrix(batch, "b") + to_child(_matrix(batch, "p") - _matrix(batch, "g"), SIBLING_COMPATIBILITY)
            belief = _matrix(batch, "e") + to_child(group - _matrix(batch, "u"), FILE_COMPATIBILITY)
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("path"), pa.array(np.array(LABELS, object)[belief.argmax(axis=1)], pa.string())], names=["tree", "path", "label"])

    groups = siblings.select("tree", "dir", "kind", *_vector("b"), *[F.col(f"u{i}").alias(f"g{i}") for i in range(5)]).join(beliefs, ["tree", "dir"])
    return base.join(groups, ["tree", "dir", "kind"]).select("tree", "path", *[c for x in "ebupg" for c in _vector(x)]).mapInArrow(finish, "tree string, path string, label string")


def label_files(files: DataFrame, snapshots: DataFrame, symbol_versions: DataFrame) -> DataFrame:
    """(file_id, label) of every file_id; label is one of LABELS.

    Trees are repositories (a file of an unknown snapshot stands in a tree of
    that snapshot alone). Evidence of a path is taken over all its versions. A
    null path has no evidence but its bodies'; null bodies give none; null
    file_ids are left out; repeated rows count once; empty tables give no rows.
    """
    repo = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max("repo_id").alias("repo_id"))
    placed = (
        files.where("file_id is not null")
        .select("file_id", "snapshot_id", F.regexp_replace(F.regexp_replace(F.coalesce("path", F.lit("")), r"[\\/]+", "/"), r"^(\./)*/?", "").alias("path"))
        .distinct()
        .join(repo, "snapshot_id", "left")
        .select("file_id", F.coalesce("repo_id", "snapshot_id", F.lit("")).alias("tree"), "path")
    )
    signs = scan_distinct_text(symbol_versions.where("file_id is not null"), "body_hash", "body_source", ["file_id"], body_signs, [("sign", pa.string())], "file_id string, sign string").groupBy("file_id").agg(F.collect_set("sign").alias("signs"))
    placed = cut(placed)
    return placed.join(propagate(file_evidence(placed, signs)), ["tree", "path"]).select("file_id", "label").distinct()
