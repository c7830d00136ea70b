"""Parallel-logic scoring: candidate buckets, evidence, contradictions, relation types."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewire.functions import hashing as H
from sedgewire.functions import text as T

# Weights of the evidence, its least total and number of families.
WEIGHTS = {"logic": 0.20, "name": 0.20, "signature": 0.15, "behavior": 0.15, "contract": 0.15, "tests": 0.10, "history": 0.05}
LEAST_TOTAL, LEAST_FAMILIES, LIVE_FAMILY = 0.60, 2, 0.1
#: Columns whose equal values make a class; the best by name and by signature that a target takes, and the next ones of its kind (parameters of the feature).
CLASSES = ("body_hash", "ast_hash", "normalized_ast_hash", "name", "s")
NAMES, SIGNATURES, PROFILES, KINDS = 30, 30, 30, 20
LEAST_NAME, LEAST_SIGNATURE = 0.3, 0.05
MOST = max(NAMES, SIGNATURES)
#: Symbols that one task holds at a time, of each of two blocks; a larger repository is cut into blocks, all pairs of which are worked through.
BLOCK = 16_384
#: Tasks over pairs of blocks.
TASKS = 240


def class_links(symbols: DataFrame, column: str) -> DataFrame:
    """(a, b): the first symbol of each class of a repository with each other one; (class, member) says the same as all pairs."""
    w = Window.partitionBy("repo_id", column)
    first = symbols.where(F.col(column).isNotNull()).select(F.min("id").over(w).alias("a"), F.col("id").alias("b"))
    return first.where("a <> b")


def following(symbols: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(a, b): each symbol with the next ones by id among those of equal columns; a class of any size gives at most ``most`` per symbol."""
    w = Window.partitionBy("repo_id", *columns).orderBy("id").rowsBetween(1, most)
    return symbols.where(F.col(columns[-1]).isNotNull()).select(F.col("id").alias("a"), F.collect_list("id").over(w).alias("bs")).select("a", F.explode("bs").alias("b"))


def best_pairs(scored: DataFrame, most: int) -> DataFrame:
    """(a, b), a < b, of (query, id, similarity): the ``most`` best of each query."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"))


def split_groups(rows: DataFrame, by: str) -> DataFrame:
    """Rows of a repository's groups (i, j): each row has its block by the hash of ``by`` and goes to all groups that hold this block.

    ``rows``: repo_id, splits (blocks of the repository, see ``splits``); equal
    values of ``by`` share a block.
    """
    at = rows.withColumn("block", F.pmod(F.xxhash64(by), "splits").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    return at.withColumns({"i": F.least("block", "other").cast("int"), "j": F.greatest("block", "other").cast("int")}).drop("other", "splits")


def splits(rows: Column) -> Column:
    """Blocks of a repository of so many symbols."""
    return F.ceil(rows / BLOCK).cast("int")


def _searched(groups: DataFrame, prepare, find, id_type: str) -> DataFrame:
    """(query, id, similarity) from each group: the best ids for each query, those of its own block in (i, i) and of the other in (i, j).

    ``prepare`` makes of a group's rows, one per value and by id, whatever
    ``find(made, query, candidates)`` reads, which gives numbers of candidates
    and their similarities.
    """

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        value = pc.fill_null(rows.column("value").combine_chunks().dictionary_encode().indices, -1).to_numpy()
        rows = rows.take(pa.array(np.sort(np.unique(value, return_index=True)[1])))
        ids, block = rows.column("id").combine_chunks(), rows.column("block").to_numpy()
        i, j = (rows.column(c)[0].as_py() for c in ("i", "j"))
        queries, found, similar = [], [], []
        for own, other in {(i, j), (j, i)}:
            made = prepare(rows, np.flatnonzero(block == other))
            for q in np.flatnonzero(block == own):
                at, x = find(made, q)
                keep = at != q
                at, x = at[keep], x[keep]
                if at.size > MOST:
                    best = np.argsort(-x, kind="stable")[:MOST]
                    at, x = at[best], x[best]
                queries.append(np.full(at.size, q))
                found.append(at)
                similar.append(x)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        return pa.table({"query": ids.take(pa.array(join(queries, np.int64))), "id": ids.take(pa.array(join(found, np.int64))), "similarity": join(similar, np.float64)})

    return groups.groupBy("repo_id", "i", "j").applyInArrow(search, f"query {id_type}, id {id_type}, similarity double")


def _postings(rows: pa.Table, candidates: np.ndarray) -> tuple:
    """Codes of each row's set, sizes, and the candidates that have each code."""
    sets = rows.column("t").combine_chunks()
    flat = sets.flatten().dictionary_encode()
    codes, sizes = flat.indices.to_numpy(), pc.list_value_length(sets).to_numpy()
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mine = np.isin(owner, candidates)
    order = np.argsort(codes[mine], kind="stable")
    return codes, sizes, ends, owner[mine][order], np.searchsorted(codes[mine][order], np.arange(len(flat.dictionary) + 1))


def _by_overlap(made: tuple, q: int) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes, ends, owners, starts = made
    own = codes[ends[q] - sizes[q] : ends[q]]
    shared = np.bincount(np.concatenate([owners[:0], *[owners[starts[c] : starts[c + 1]] for c in own]]), minlength=len(sizes))
    at = np.flatnonzero(shared)
    x = shared[at] / (sizes[q] + sizes[at] - shared[at])
    return at[x >= LEAST_NAME], x[x >= LEAST_NAME]


def by_name(symbols: DataFrame) -> DataFrame:
    """(query, id, similarity): names of a repository that share trigrams, by their first symbols; of a group the best of each query."""
    names = symbols.where("name is not null").select("repo_id", "splits", "id", F.col("name").alias("value"), T.trigrams(F.col("name")).alias("t"))
    return _searched(split_groups(names, "value"), _postings, _by_overlap, symbols.schema["id"].dataType.simpleString())


def _bands(rows: pa.Table, candidates: np.ndarray) -> tuple:
    """Signatures, the code of each band of each row, and the candidates of each code."""
    places = H.unpacked(rows.column("value").combine_chunks())
    width = places.shape[1] // H.BANDS
    bands = []
    for b in range(H.BANDS):
        piece = np.ascontiguousarray(places[:, b * width : (b + 1) * width])
        code = np.unique(piece.view(f"V{piece.itemsize * width}")[:, 0], return_inverse=True)[1].ravel()
        order = candidates[np.argsort(code[candidates], kind="stable")]
        starts = np.searchsorted(code[order], np.arange(code.max(initial=0) + 2))
        bands.append((code, order, starts))
    alone = np.all([(starts[1:] - starts[:-1])[code] <= np.isin(np.arange(len(code)), candidates) for code, _, starts in bands], axis=0)
    return places, bands, alone


def _by_places(made: tuple, q: int) -> tuple[np.ndarray, np.ndarray]:
    places, bands, alone = made
    if alone[q]:
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.unique(np.concatenate([order[starts[code[q]] : starts[code[q] + 1]] for code, order, starts in bands]))
    x = H.equal_places(places[at], places[q]) / H.PLACES
    return at[x >= LEAST_SIGNATURE], x[x >= LEAST_SIGNATURE]


def by_signature(symbols: DataFrame) -> DataFrame:
    """(query, id, similarity): signatures of a repository that share a band, by their first symbols; of a group the best of each query."""
    first = symbols.where(F.col("s").isNotNull()).select("repo_id", "splits", "id", F.col("s").alias("value"))
    return _searched(split_groups(first, "value"), _bands, _by_places, symbols.schema["id"].dataType.simpleString())


def candidates(symbols: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of symbols of a repository worth comparing, from seven buckets.

    ``symbols``: id, repo_id, kind, purity, name, body_hash, ast_hash,
    normalized_ast_hash, s (signature); one row per symbol, null ids and
    repositories left out. Symbols of one body, syntax, normalized syntax, name
    or signature (an array, or packed) are linked to the first of their class; names and signatures
    that are similar are linked by these first ones, the best of each; the last
    two buckets are the next symbols of the same purity and kind, and kind.
    """
    known = symbols.where("id is not null and repo_id is not null")
    if "splits" not in known.columns:
        known = known.withColumn("splits", splits(F.count("*").over(Window.partitionBy("repo_id"))))
    if dict(known.dtypes)["s"] != "binary":
        known = H.packed(known, "s")
    parts = [class_links(known, c) for c in CLASSES] + [best_pairs(by_name(known), NAMES), best_pairs(by_signature(known), SIGNATURES), following(known, ["purity", "kind"], PROFILES), following(known, ["kind"], KINDS)]
    return reduce(DataFrame.unionByName, [p.select("a", "b") for p in parts]).distinct()


def _common(lists: pa.Array):
    """A function that counts what the rows ``a`` and ``b`` of an array of sets share, pair by pair."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().dictionary_encode()
    codes, known = values.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(values.dictionary))
    starts = np.cumsum(sizes) - sizes
    keys = np.sort(np.repeat(np.arange(len(sizes)), sizes) * known + codes)

    def count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(a.size, np.int64)
        less = sizes[a] <= sizes[b]
        few, many = np.where(less, a, b), np.where(less, b, a)
        some = np.flatnonzero(sizes[few])
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(sizes[few[some]]) // 1_000_000)) + 1):
            if not part.size:
                continue
            n = sizes[few[part]]
            pair = np.repeat(np.arange(part.size), n)
            item = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[few[part]][pair]
            asked = many[part][pair] * known + codes[item]
            hit = keys[np.minimum(np.searchsorted(keys, asked), keys.size - 1)] == asked
            out[part] = np.bincount(pair[hit], minlength=part.size)
        return out

    return count


def block_copies(symbols: DataFrame) -> DataFrame:
    """``symbols`` with the pairs of blocks (i, j), i <= j, in which they are compared: those of the blocks that hold a part of their own repository."""
    at = symbols.withColumn("block", F.shiftright("no", BLOCK.bit_length() - 1))
    own = at.select("repo_id", "block").distinct()
    spread = own.join(own.withColumnRenamed("block", "other"), "repo_id")
    return at.join(spread, ["repo_id", "block"]).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "other")


def beside(symbols: DataFrame, pairs: DataFrame, equal: list[str], sets: list[str], kept: list[str]) -> DataFrame:
    """For each pair (a, b): places (equal ones of the signatures), same_* of the ``equal`` columns (null if one is), shared_* of the ``sets`` (what they share) and both symbols' ``kept`` columns.

    ``symbols``: no (numbered by repository, then id), repo_id, s (packed) and
    the named columns. Rows are brought together by pairs of blocks, so that a
    symbol travels once for each block of its repository instead of once for
    each of its pairs.
    """
    left = block_copies(symbols).select("i", "j", F.lit(0).alias("part"), F.struct(*dict.fromkeys(["no", "s", *equal, *sets, *kept])).alias("symbol"))
    right = pairs.select(F.shiftright("a", BLOCK.bit_length() - 1).alias("i"), F.shiftright("b", BLOCK.bit_length() - 1).alias("j"), F.lit(1).alias("part"), "a", "b")
    # not by the shuffle's own number of partitions, which is made smaller by bytes: the work is in the pairs
    rows = left.unionByName(right, allowMissingColumns=True).repartition(TASKS, "i", "j").sortWithinPartitions("i", "j", "part", "a")
    kinds = dict(symbols.dtypes)
    fields = ["places int", *[f"same_{c} boolean" for c in equal], *[f"shared_{c} int" for c in sets], *[f"{c}_{x} {kinds[c]}" for x in "ab" for c in kept]]
    names = [f.split()[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, known = None, None
        for batch in batches:
            i, j, part = (batch.column(c).to_numpy() for c in ("i", "j", "part"))
            starts = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(part) != 0)]) if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                rows = batch.slice(start, end - start)
                if group != (i[start], j[start]):
                    group, held, known = (i[start], j[start]), [], None
                if part[start] == 0:
                    held.append(rows)
                    continue
                if known is None:
                    table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x.column("symbol")) for x in held])
                    column = lambda c: table.column(c).combine_chunks()
                    number = lambda c: column(c).dictionary_encode().indices
                    known, held = (column("no"), H.unpacked(column("s")), [number(c) for c in equal], [_common(column(c)) for c in sets], [column(c) for c in kept]), []
                no, places, compared, counted, columns = known
                a, b = (pc.index_in(rows.column(c), no) for c in ("a", "b"))
                x, y = (k.to_numpy(zero_copy_only=False) for k in (a, b))
                same = [pc.equal(c.take(a), c.take(b)) for c in compared]
                numbers = [pa.array(n.astype(np.int32)) for n in [H.equal_places(places[x], places[y]), *[c(x, y) for c in counted]]]
                yield pa.RecordBatch.from_arrays([numbers[0], *same, *numbers[1:], *[c.take(k) for k in (a, b) for c in columns]], names=names)

    return rows.mapInArrow(run, ", ".join(fields))


def logic_similarity(same_body: Column, same_normal: Column, same_ast: Column, places: Column) -> Column:
    """From equal hashes, else the share of equal places of the signatures (none equal if one is missing)."""
    return F.when(same_body, 1.0).when(same_normal, 0.90).when(same_ast, 0.85).otherwise(places / H.PLACES)


def behavioral_overlap(touches_a: Column, touches_b: Column, shared: Column, same_purity: Column, pure: Column) -> Column:
    """From the numbers of touched resources and of those that both touch, equal purity and whether the first is pure."""
    none = (touches_a == 0) & (touches_b == 0)
    return F.when(none & same_purity & ~pure, 0.3).when(none, 0.0).otherwise(F.least(F.lit(1.0), T.jaccard_of(shared, touches_a, touches_b) + F.when(same_purity, 0.2).otherwise(0.0)))


def contract_overlap(fields: list[tuple[Column, Column, Column]]) -> Column:
    """Equal ones among the fields that both state: (stated by a, by b, same)."""
    total = reduce(lambda x, y: x + y, [F.when(a & b, 1).otherwise(0) for a, b, _ in fields])
    equal = reduce(lambda x, y: x + y, [F.when(a & b & same, 1).otherwise(0) for a, b, same in fields])
    return F.when(total > 0, equal / total).otherwise(0.0)


def total_score(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(total, families): weighted sum and number of live kinds of evidence; very similar logic lifts both."""
    raw = reduce(lambda x, y: x + y, [F.lit(w) * scores[k] for k, w in WEIGHTS.items()])
    live = reduce(lambda x, y: x + y, [F.when(scores[k] > LIVE_FAMILY, 1).otherwise(0) for k in WEIGHTS])
    strong = scores["logic"] >= 0.85
    return F.when(strong, F.greatest(raw, F.lit(0.85))).otherwise(raw), F.when(strong, F.greatest(live, F.lit(3))).otherwise(live)


def contradictions(same_purity: Column, same_exceptions: Column, same_auth: Column, same_io: Column, io_both: Column) -> Column:
    """Sorted flags of what speaks against a pair."""
    flags = {"exception_semantics_differ": ~same_exceptions, "io_shape_diverges": ~same_io & io_both, "security_context_differs": ~same_auth, "side_effects_differ": ~same_purity}
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in sorted(flags.items())]))


# Relations of two symbols of one kind.
KIND_RELATIONS = {"validator": "validator_homolog", "serializer": "serializer_homolog", "query_builder": "query_logic_duplicate"}


def relation_type(scores: dict[str, Column], auth_both: Column, throws_both: Column, kinds: tuple[Column, Column]) -> Column:
    rules = F.when(scores["logic"] >= 0.85, "near_duplicate_logic")
    for kind, relation in KIND_RELATIONS.items():
        rules = rules.when((kinds[0] == kind) & (kinds[1] == kind), relation)
    return (
        rules
        .when((scores["behavior"] >= 0.60) & auth_both, "auth_policy_peer")
        .when((scores["contract"] >= 0.50) & throws_both, "error_mapping_peer")
        .when((scores["behavior"] >= 0.70) & (scores["contract"] >= 0.50), "business_rule_parallel")
        .when(scores["contract"] >= 0.70, "contract_sibling")
        .when(scores["signature"] >= 0.80, "normalization_homolog")
        .otherwise("near_duplicate_logic")
    )


def rationale(scores: dict[str, Column]) -> Column:
    """What speaks for a pair, in words."""
    percent = F.concat(F.lit("logic similarity: "), F.round(scores["logic"] * 100).cast("int").cast("string"), F.lit("%"))
    said = F.concat_ws(
        "; ",
        F.when(scores["logic"] >= 0.85, "near-identical logic").when(scores["logic"] > 0, percent),
        F.when(scores["name"] >= 0.70, "strong name similarity"),
        F.when(scores["signature"] >= 0.70, "matching signatures"),
        F.when(scores["behavior"] >= 0.70, "overlapping behavior"),
        F.when(scores["contract"] >= 0.70, "matching contracts"),
        F.when(scores["tests"] > 0, "shared test coverage"),
        F.when(scores["history"] > 0, "historical co-change"),
    )
    return F.when(said == "", "weak evidence").otherwise(said)
