"""N-gram Jaccard join by a token-group matrix: groups of similar sets, each with the union of its tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_roots, hosts_and_guests
from .common import blocks, components, numbered, renamed, staged, table, text_key, unstage
from .rolling import mix, window_hashes, words_of

#: Least hashes of a set under so many orders; sets that share one are compared with the centre of those that do.
ORDERS = 8
#: Sets of a block, and tokens of an incidence matrix at a time.
BLOCK_ROWS, TOKENS_AT_ONCE = 512, 1 << 14

MARKS = "key binary, set_key binary, n long, least array<long>, first array<long>"
NO_WORD = r"\A[\x20\x09-\x0D]*\z"


def shingles(texts: list[str], size: int) -> list[np.ndarray]:
    """For each text the hashes of its different shingles of size words, ascending; of its whole sequence if it has fewer words."""
    values, begin = words_of([t.encode().lower() for t in texts])
    hashes = window_hashes(values, size)
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        else:
            out.append(window_hashes(values[a:b], int(b - a)) ^ np.uint64(b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ORDERS least hashes for each set, none of them empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(mix(flat ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))), at) for j in range(ORDERS)], axis=1).view(np.int64)


def needed(n: int, percent: int) -> int:
    """So many tokens at least a set of n shares with any that it links with."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """So many tokens beyond the first that must meet are looked at: more of them let fewer sets pass by chance."""
    return n // 8


def first_tokens(n: int, percent: int) -> int:
    """So many first tokens, in any order common to all sets, hold 1 + spare(n) of a partner's first ones."""
    return min(n, n - needed(n, percent) + 1 + spare(n))


def bound(percent: int) -> Column:
    """What a set of n tokens and any partner have in common at least in their first tokens: 1 + spare() of the smaller."""
    return (F.floor(F.col("n") * percent / 800) + 1).cast("int")


def lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))


def mark_pass(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text, first_id) to MARKS and first_id; first: the least first_tokens() tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            sets = shingles(batch.column(1).to_pylist(), size)
            least: list[list[int]] = [[] for _ in sets]
            if full := [i for i, s in enumerate(sets) if len(s)]:
                for i, row in zip(full, least_hashes([sets[i] for i in full]).tolist(), strict=True):
                    least[i] = row
            keys, n = pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())
            first = lists([s[: first_tokens(len(s), percent)] for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, n, pa.array(least, pa.list_(pa.int64())), first, batch.column(2)], names=["key", "set_key", "n", "least", "first", "first_id"])

    return run


def token_pass(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sid, home, n, text) to (sid, home, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            tokens = lists(shingles(batch.column(3).to_pylist(), size))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), tokens], names=["sid", "home", "n", "tokens"])

    return run


def similar_groups(sets: DataFrame) -> DataFrame:
    """(sid, home): groups of at least two sets that are somewhat alike, home their centre; staged. Other sets aren't in it.

    The sets that share a least hash have a centre: the one with the most company over all its least hashes, in a group
    of edited copies the text they come from. A set joins the centre that it shares the most, at least two, least hashes
    with, unless it is the centre of others itself. Groups only save work: links between them are found as well.
    """
    entries = sets.select("sid", F.posexplode("least").alias("order", "value"))
    company = entries.groupBy("order", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = staged(entries.join(company, ["order", "value"]), "shared")
    weight = shared.groupBy("sid").agg(F.round(F.sum(F.log2("c")), 6).alias("weight"))
    weighed = staged(shared.join(weight, "sid").select("sid", "order", "value", F.struct("weight", F.xxhash64("sid").alias("r"), "sid").alias("w")), "weighed")
    centres = weighed.groupBy("order", "value").agg(F.max("w").alias("centre"))
    met = weighed.join(centres, ["order", "value"]).where("sid <> centre.sid").groupBy("sid", "centre").agg(F.count(F.lit(1)).alias("met")).where("met >= 2")
    joined = staged(met.groupBy("sid").agg(F.max(F.struct("met", "centre")).alias("m")).select("sid", F.col("m.centre.sid").alias("home")), "joined")
    unstage(shared, weighed)
    centre = joined.select("home").distinct()
    member = joined.join(centre.select(F.col("home").alias("sid")), "sid", "left_anti")
    # a centre whose only company are centres of others has none left
    lasting = member.select("home").distinct()
    groups = staged(member.unionByName(lasting.select(F.col("home").alias("sid"), "home")), "groups")
    unstage(joined)
    return groups


def surviving(sets: DataFrame, percent: int) -> DataFrame:
    """(sid): the sets (sid, home, n, first) that may be alike to one of another group; staged.

    It bounds the overlap of a set with all other groups at once: a partner shares bound() tokens among the first
    of both, so at least as many of a set's first tokens must be another group's as well.
    """
    tokens = sets.select("sid", "home", F.explode("first").alias("token"))
    seen = tokens.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high"))
    shared = staged(seen.where("low <> high").select("token"), "shared")
    hits = tokens.select("sid", "token").join(shared, "token").groupBy("sid").agg(F.count(F.lit(1)).alias("overlap"))
    out = staged(hits.join(sets.select("sid", "n"), "sid").where(F.col("overlap") >= bound(percent)).select("sid"), "surviving")
    unstage(shared)
    return out


def pair_needed(n: Column, others: Column, percent: int) -> Column:
    """So many tokens at least a set of n shares with a linked one of a group whose smallest has so many."""
    least = F.greatest(others, F.ceil(n * percent / 100))
    return F.ceil(percent * (n + least) / (100 + percent)).cast("int")


def opened_groups(found: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(sid, cell): the other groups that a set is to be compared with; found: (sid, home, n, tokens), sizes: (home, sets,
    smallest) of the groups. Staged. Of two groups the one of fewer sets asks.

    The matrix holds the union of each group's tokens, but for those of one group alone, which meet no other. A partner
    shares needed() tokens with a set; all are among the set's tokens in the matrix. These go by how few groups they are
    in, then by hash. However a group's tokens lie, all but pair_needed() of them may be missed, so of the first so many
    a number that follows from it must be in the group's union: else the group stays closed.
    """
    entries = found.select("sid", "home", F.explode("tokens").alias("token"))
    union = staged(entries.select("token", "home").distinct(), "union")
    spread = union.groupBy("token").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1")
    cell = sizes.select(F.col("home").alias("cell"), F.struct("sets", F.col("home").alias("at")).alias("theirs"), "smallest")
    matrix = staged(union.join(spread, "token").select("token", F.col("home").alias("cell"), "spread").join(cell, "cell"), "matrix")
    unstage(union)
    common = matrix.groupBy("token").agg(F.first("spread").alias("spread"))
    shared = entries.join(common, "token").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("spread", "token"))).alias("shared"))
    mine = sizes.select("home", F.struct("sets", F.col("home").alias("at")).alias("mine"))
    ranked = found.select("sid", "home", "n").join(shared, "sid").join(mine, "home").withColumn("all", F.size("shared"))
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    take = F.least(F.col("all"), F.col("all") - least + 1 + F.floor(F.col("n") / 8).cast("int"))
    ranked = ranked.where(F.col("all") >= least).withColumn("take", take)
    first = ranked.select("sid", "mine", "n", F.struct("take", "all").alias("of"), F.explode(F.slice("shared", 1, F.col("take"))).alias("entry"))
    first = staged(first.select("sid", "mine", "n", "of", F.col("entry.token").alias("token")), "first")
    met = first.join(matrix, "token").where("mine < theirs").groupBy("sid", "cell")
    overlap = met.agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("n", "of", "smallest")])
    out = overlap.where(F.col("c") >= F.col("of.take") - F.col("of.all") + pair_needed(F.col("n"), F.col("smallest"), percent))
    out = staged(out.select("sid", "cell"), "opened")
    unstage(first, matrix)
    return out


def compare_sets(percent: int):
    """Guests and hosts of one cell to (a, b): each set with links and the least set they lead to here.

    Intersections are products of the blocks' incidence matrices over the tokens that two of their sets have.
    """

    def run(rows: pa.Table) -> pa.Table:
        side, n, sid = (np.asarray(rows.column(c)) for c in ("side", "n", "sid"))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        tokens = rows.column("tokens").combine_chunks()
        row = np.repeat(np.arange(len(tokens)), np.diff(np.asarray(tokens.offsets)))
        _, token, times = np.unique(np.asarray(tokens.flatten()), return_inverse=True, return_counts=True)
        often = np.flatnonzero(times > 1)
        common = np.zeros((len(first), len(second)), dtype=np.int64)
        for start in range(0, len(often), TOKENS_AT_ONCE):
            column = np.full(len(times), -1)
            some = often[start : start + TOKENS_AT_ONCE]
            column[some] = np.arange(len(some))
            at = column[token]
            matrix = np.zeros((len(side), len(some)), dtype=np.float32)
            matrix[row[at >= 0], at[at >= 0]] = 1
            common += (matrix[first] @ matrix[second].T).astype(np.int64)
        near = common * 100 >= (n[first][:, None] + n[second][None] - common) * percent
        near &= sid[first][:, None] != sid[second][None]
        left, right = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        nodes = np.concatenate([sid[first[left]], sid[second[right]]])
        roots = block_roots(nodes, near[np.ix_(left, right)], False)
        out = np.unique(np.stack([nodes, roots], axis=1), axis=0)
        out = out[out[:, 0] != out[:, 1]]
        return pa.table({"a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64())})

    return run


def linked_with_centre(members: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): sets that link with their group's centre, and it; and (sid, cell): those that don't but may link with others
    of their group, cell its name. members: (sid, home, n, tokens), sizes: (home, sets, smallest). Both staged.

    Sets linked with the centre are in one component, whatever else links them. For another one the group's union, without
    what it has alone, bounds what it shares with any: the tokens of the centre, and those of others that two have.
    """
    centre = members.where("sid = home").select("home", F.col("tokens").alias("others"), F.col("n").alias("m"))
    own = members.where("sid <> home").join(centre, "home").withColumn("common", F.size(F.array_intersect("tokens", "others")).cast("long"))
    near = F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent
    own = staged(own.select("sid", "home", "n", "common", near.alias("near"), F.array_except("tokens", "others").alias("rest")), "own")
    entries = own.select("home", F.explode("rest").alias("token"))
    twice = staged(entries.groupBy("home", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("home", "token"), "twice")
    far = own.where("not near").select("sid", "home", F.explode("rest").alias("token")).join(twice, ["home", "token"])
    more = far.groupBy("sid").agg(F.count(F.lit(1)).alias("more"))
    asking = own.where("not near").select("sid", "home", "n", "common").join(more, "sid", "left").join(sizes, "home")
    enough = F.col("common") + F.coalesce("more", F.lit(0)) >= pair_needed(F.col("n"), F.col("smallest"), percent)
    asking = staged(asking.where(enough).select("sid", F.col("home").alias("cell")), "asking")
    links = staged(own.where("near").select(F.col("sid").alias("a"), F.col("home").alias("b")), "centre-links")
    unstage(own, twice)
    return links, asking


def links_of(docs: DataFrame, raw: DataFrame, size: int, percent: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(a, b): links that lead from each set to all that it is linked with, over any number of steps; and (sid, set_key, n),
    the sets by number. Both staged.

    Within a group each set is compared with the centre first. Only sets that don't link with it and whose overlap with
    the group's union is large enough, and such guests from other groups, are compared with all of the group, two blocks
    at a time.
    """
    counted = raw.where("n > 0").groupBy("set_key").agg(F.first("n").alias("n"), F.first("least").alias("least"))
    sets = staged(counted.withColumn("sid", F.monotonically_increasing_id()), "sets")
    groups = similar_groups(sets.select("sid", "least"))
    placed = sets.select("sid", "set_key", "n").join(groups, "sid", "left").withColumn("home", F.coalesce("home", "sid"))
    placed = staged(placed, "placed")
    sizes = staged(placed.groupBy("home").agg(F.count(F.lit(1)).alias("sets"), F.min("n").alias("smallest")), "group-sizes")
    firsts = raw.where("n > 0").groupBy("set_key").agg(F.first("first").alias("first")).join(placed.select("set_key", "sid", "home", "n"), "set_key")
    firsts = staged(firsts.select("sid", "home", "n", "first"), "firsts")
    alone = surviving(firsts, percent)
    unstage(firsts)
    # one text stands for each set that is in a group or may be alike to one of another
    wanted = groups.select("sid").unionByName(alone).distinct()
    chosen = raw.where("n > 0").groupBy("set_key").agg(F.min("key").alias("key")).join(placed, "set_key").join(wanted, "sid", "left_semi")
    chosen = staged(chosen.select("key", "sid", "home", "n"), "chosen")
    rows = docs.select(text_key(docs[text_col]).alias("key"), docs[text_col].cast("string").alias("text"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text")).join(chosen, "key").select("sid", "home", "n", "text")
    found = staged(texts.mapInArrow(token_pass(size), "sid long, home long, n long, tokens array<long>"), "tokens")
    unstage(placed, chosen)
    near, asking = linked_with_centre(found.join(groups, ["sid", "home"], "left_semi"), sizes, percent)
    opened = opened_groups(found.join(alone, "sid", "left_semi"), sizes, percent)
    guests = found.join(opened.unionByName(asking), "sid").select("sid", "cell", "n", "tokens")
    hosts = found.select("sid", F.col("home").alias("cell"), "n", "tokens")
    pairs = hosts_and_guests(hosts, guests, BLOCK_ROWS).groupBy("cell", "i", "j")
    met = staged(pairs.applyInArrow(compare_sets(percent), "a long, b long"), "met")
    links = staged(met.unionByName(near), "links")
    unstage(groups, sizes, alone, found, near, asking, opened, met)
    return links, sets


def similar_texts(docs: DataFrame, *, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, head) for each different text; head (late, id, key) is the first text of the
    component. A text without words has none of both. Staged."""
    rows = docs.select(text_key(docs[text_col]).alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[id_col].alias("first_id"))
    marked = rows.mapInArrow(mark_pass(size, percent), f"{MARKS}, first_id {rows.schema['first_id'].dataType.simpleString()}")
    raw = staged(marked, "marks")
    texts = staged(raw.groupBy("key", "set_key", "n").agg(F.min("first_id").alias("first_id")), "keys")
    links, sets = links_of(docs, raw, size, percent, text_col)
    unstage(raw)
    roots = components(links).select(F.col("node").alias("sid"), "root")
    named = sets.select("set_key", "sid").join(roots, "sid", "left").select("set_key", F.coalesce("root", "sid").alias("root"))
    rooted = staged(texts.join(named, "set_key", "left").select("key", "n", "first_id", "root"), "rooted")
    head = F.struct(F.col("first_id").isNull().alias("late"), F.col("first_id").alias("id"), "key")
    ids = rooted.where("n > 0").groupBy("root").agg(F.min("first_id").alias("component_id"), F.min(head).alias("head"))
    out = staged(rooted.join(ids, "root", "left").select("key", F.col("n").alias("n_shingles"), "component_id", "head"), "similar")
    unstage(texts, links, sets, rooted)
    return out


def with_components(docs: DataFrame, *, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles and component_id behind its columns: the size of the text's set of different shingles, and
    the smallest id of the documents reachable by links. Documents link at 100 * intersection >= percent * union.

    Words are runs of other characters than \x20 and \x09-\x0D, A-Z in lower case; a text of fewer than size words has
    its whole sequence as one shingle. No link between different texts is lost: what the groups leave out is found by
    exact bounds.

    A null text or one without words has no shingles and links with nothing: its component is its own id. Ids are of any
    type that can be ordered. Null ids don't count for the smallest; without any other it is null. Repeated rows and ids
    stay. Columns with the new names are replaced, any other may have any name; an empty table stays empty. Shingles are
    told apart by 64 bits, sets by 128.
    """
    named, old = numbered(docs, ("n_shingles", "component_id"))
    id_name, text_name = f"c{old.index(id_col)}", f"c{old.index(text_col)}"
    found = similar_texts(named, size=size, percent=percent, id_col=id_name, text_col=text_name)
    rows = named.withColumn("key", text_key(named[text_name])).join(found, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col(id_name)).otherwise(F.col("component_id"))
    return renamed(rows, old, "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id (null ids last), of several the one whose text
    hashes lowest, of repeated rows any one. Documents without words, null texts too, all stay. Ids are of any type that
    can be ordered; any column may have any name; an empty table stays empty."""
    named, old = numbered(docs)
    id_name, text_name = f"c{old.index(id_col)}", f"c{old.index(text_col)}"
    found = similar_texts(named, size=size, percent=percent, id_col=id_name, text_col=text_name)
    stay = found.where("n_shingles > 0 and head.key = key").select(F.col("key").alias("head"), F.col("head.id").alias("head_id"))
    empty = F.coalesce(F.col(text_name).cast("string"), F.lit("")).rlike(NO_WORD)
    rows = named.where(~empty).withColumn("key", text_key(named[text_name]))
    # rows are dealt by key and id, so copies of one text aren't dealt to one task
    kept = rows.join(stay, (F.col("key") == F.col("head")) & F.col(id_name).eqNullSafe(F.col("head_id"))).dropDuplicates(["key", id_name])
    return renamed(named.where(empty).unionByName(kept.select(*named.columns)), old)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return with_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT r, count(*) AS n FROM tokens GROUP BY r
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM tokens x JOIN tokens y ON x.t = y.t AND x.r <> y.r GROUP BY ALL)
  JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT r AS a, r AS b FROM words
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT words.doc_id, CAST(coalesce(any_value(sizes.n), 0) AS BIGINT) AS n_shingles, min(other.doc_id) AS component_id
FROM words LEFT JOIN sizes ON sizes.r = words.r JOIN reach ON reach.a = words.r JOIN words other ON other.r = reach.b
GROUP BY words.r, words.doc_id
"""
