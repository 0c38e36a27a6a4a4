"""The ontology graph: levels, closure, inheritance, evidence and term queries.

Edges are (child, parent, rel) with rel 1 is_a, 2 part_of, 3 replaced by. Terms are (gonum, name, domain, level).
Iterations run on frontiers and stop when nothing is new; lineage is cut in each. Their joins are merge joins by hint: a
frontier that is small in its round would be broadcast through the driver, round after round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandlake.plans.lineage import cut

REPLACED = 3
#: Terms in the paths that a task hands over at once.
HELD_TERMS = 1 << 20
#: Evidence codes by category.
EVIDENCE = {
    "experimental": ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP"),
    "high_throughput": ("HTP", "HDA", "HMP", "HGI", "HEP"),
    "phylogenetic": ("IBA", "IBD", "IKR", "IRD"),
    "computational": ("ISS", "ISO", "ISA", "ISM", "IGC", "RCA"),
    "author": ("TAS", "NAS"),
    "curator": ("IC", "ND"),
    "electronic": ("IEA", "UNK"),
}


def levels(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """gonum and level: one more than the longest path from a root, without rel 3. A longer path replaces a shorter one
    until none does; a graph with more than ``most`` steps is not acyclic."""
    steps = cut(edges.where(F.col("rel") != REPLACED).select("child", "parent").distinct())
    known = cut(roots.select("gonum", F.lit(1).alias("level")))
    front = known
    for _ in range(most):
        found = front.join(steps.hint("merge"), F.col("gonum") == F.col("parent")).groupBy(F.col("child").alias("gonum")).agg((F.max("level") + 1).alias("level"))
        old = known.select("gonum", F.col("level").alias("_old"))
        front = cut(found.join(old.hint("merge"), "gonum", "left").where(F.col("_old").isNull() | (F.col("level") > F.col("_old"))).select("gonum", "level"))
        if not front.head(1):
            return known
        known = cut(known.unionByName(front).groupBy("gonum").agg(F.max("level").alias("level")))
    raise ValueError("the graph has a cycle")


def closure(edges: DataFrame, most: int = 100) -> DataFrame:
    """child, ancestor, rel, distance for all ancestors: rel is the smallest on a shortest path, distance its steps.

    A round moves the ways that the last one found from a parent to its children, so it reads and writes those alone; a pair's
    shortest way is chosen once, at the end. Pairs known from shorter ways are taken out of rounds 8, 16, 32 and so on, and
    of the last one, which is what ends a walk around a cycle."""
    steps = cut(edges.where(F.col("rel") != REPLACED).groupBy("child", "parent").agg(F.min("rel").alias("rel")))
    down = steps.select(F.col("child").alias("_next"), F.col("parent").alias("child"), F.col("rel").alias("_rel"))
    front = steps.select("child", F.col("parent").alias("ancestor"), "rel", F.lit(1).alias("distance"))
    ways = front
    for n in range(2, most + 2):
        found = front.join(down.hint("merge"), "child").groupBy(F.col("_next").alias("child"), "ancestor").agg(F.min(F.least("rel", "_rel")).alias("rel")).withColumn("distance", F.lit(n))
        if n > most or n >= 8 and n & (n - 1) == 0:
            found = found.join(ways.select("child", "ancestor").hint("merge"), ["child", "ancestor"], "left_anti")
        front = cut(found)
        if not front.head(1):
            best = ways.repartition("child").groupBy("child", "ancestor").agg(F.min(F.struct("distance", "rel")).alias("_w"))
            return best.select("child", "ancestor", "_w.rel", "_w.distance")
        ways = ways.unionByName(front)
    raise ValueError("the graph has a cycle")


def direct_terms(hits: DataFrame) -> DataFrame:
    """hit_id, gonum, ec from hits whose ``go`` is an array of (gonum, ec)."""
    return hits.select("hit_id", F.explode("go").alias("_g")).select("hit_id", "_g.gonum", "_g.ec").distinct()


def inherited_terms(direct: DataFrame, paths: DataFrame) -> DataFrame:
    """hit_id, gonum, ec, is_direct: assigned terms, and their ancestors with the evidence in brackets. An assigned term
    wins; of several children that give a term, the smallest evidence does.

    A term's ancestors are gathered in an array, joined by merge to the hits that have it, and unfolded where the rows of a
    hit have met, so neither side is broadcast and rows of hits and ancestors are not shuffled."""
    up = paths.groupBy(F.col("child").alias("gonum")).agg(F.collect_list("ancestor").alias("_up"))
    # A fixed number of partitions: rows get many times more when they are unfolded, after the shuffle.
    n = int(direct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = direct.join(up.hint("merge"), "gonum", "left").repartition(n, "hit_id")
    each = rows.select("hit_id", "ec", F.posexplode(F.coalesce(F.concat(F.array("gonum"), "_up"), F.array("gonum"))).alias("_i", "gonum"))
    own = F.col("_i") == 0
    best = each.groupBy("hit_id", "gonum").agg(F.min(F.when(own, F.col("ec"))).alias("_own"), F.min(F.when(~own, F.col("ec"))).alias("_up"), F.max(own).alias("is_direct"))
    return best.select("hit_id", "gonum", F.when(F.col("is_direct"), F.col("_own")).otherwise(F.concat(F.lit("("), "_up", F.lit(")"))).alias("ec"), "is_direct")


def _terms_of_hits(direct: DataFrame, paths: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """hit_id, _own, _above: each hit's assigned terms, and those that it inherits besides, of ``only`` (gonum) if given. The
    latter are in order: hits in a row then have much of their arrays in common, which a shuffle's compression takes out."""
    own = direct.select("hit_id", "gonum").distinct()
    steps = paths.select("child", "ancestor")
    kept = F.col("gonum")
    if only is not None:
        ids = only.select("gonum").distinct()
        steps = steps.join(ids.withColumnRenamed("gonum", "ancestor"), "ancestor", "left_semi")
        own = own.join(ids.withColumn("_in", F.lit(True)), "gonum", "left")
        kept = F.when(F.col("_in"), F.col("gonum"))
    up = steps.groupBy(F.col("child").alias("gonum")).agg(F.collect_list("ancestor").alias("_up"))
    terms = own.join(up, "gonum", "left").groupBy("hit_id").agg(F.collect_list(kept).alias("_own"), F.array_distinct(F.flatten(F.collect_list("_up"))).alias("_up"))
    return terms.select("hit_id", "_own", F.sort_array(F.array_except("_up", "_own")).alias("_above")).where((F.size("_own") > 0) | (F.size("_above") > 0))


def sequence_terms(hits: DataFrame, direct: DataFrame, paths: DataFrame, order: str = "bits", only: DataFrame | None = None) -> DataFrame:
    """seq_id, gonum, hit_id, evalue, is_direct: per sequence and term its best hit, and whether any hit has the term
    directly. A single dataset orders by bits, merged ones by e-value. With ``only`` (gonum), rows of these terms alone.

    A hit's terms are gathered once, in arrays of assigned and of inherited ones, and go to its sequences with it. There the
    hits are taken in order and each adds the terms that none before it had, so that rows of sequences and terms are made
    once, and never shuffled, sorted or held in a table of a task."""
    keys = {"bits": -F.col("bits"), "evalue": F.col("evalue"), "hit": F.col("hit_id")}
    names = ["bits", "evalue", "hit"] if order == "bits" else ["evalue", "bits", "hit"]
    terms = _terms_of_hits(direct, paths, only)
    # Twice the usual number of partitions: rows get many times more when they are unfolded, after the shuffle.
    n = 2 * int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hits.select("seq_id", "hit_id", "bits", "evalue").join(terms, "hit_id").repartition(n, "seq_id")
    place = [keys[k].alias(f"_{k}") for k in names]
    rows = rows.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct(*place, "hit_id", "evalue", "_own", "_above"))).alias("_hits"))
    none = F.array().cast(f"array<struct<hit_id:{dict(hits.dtypes)['hit_id']},evalue:{dict(hits.dtypes)['evalue']},new:array<{dict(direct.dtypes)['gonum']}>>>")
    add = lambda done, h: F.concat(done, F.array(F.struct(h["hit_id"].alias("hit_id"), h["evalue"].alias("evalue"), F.array_except(F.concat(h["_own"], h["_above"]), F.flatten(done["new"])).alias("new"))))
    rows = rows.select("seq_id", F.flatten("_hits._own").alias("_own"), F.inline(F.aggregate("_hits", none, add)))
    rows = rows.select("seq_id", "hit_id", "evalue", F.array_intersect("new", "_own").alias("_own"), F.array_except("new", "_own").alias("_above"))
    each = rows.select("seq_id", "hit_id", "evalue", F.size("_own").alias("_n"), F.posexplode(F.concat("_own", "_above")).alias("_i", "gonum"))
    return each.select("seq_id", "gonum", "hit_id", "evalue", (F.col("_i") < F.col("_n")).alias("is_direct"))


def best_go_hit(hits: DataFrame, direct: DataFrame) -> DataFrame:
    """The first hit of each sequence that has any term: bits, best flags, e-value, hit id."""
    rows = hits.join(direct.select("hit_id").distinct(), "hit_id", "left_semi")
    order = Window.partitionBy("seq_id").orderBy(F.desc("bits"), F.desc(F.col("best_bits").cast("int") + F.col("best_anno").cast("int")), "evalue", "hit_id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def term_info(seq_terms: DataFrame) -> DataFrame:
    return seq_terms.groupBy("gonum").agg(F.min("evalue").alias("best_evalue"), F.count(F.lit(1)).alias("n_seqs"), F.sum(F.col("is_direct").cast("long")).alias("n_direct"))


def used_only(graph: DataFrame, used: DataFrame, a: str = "child", b: str = "ancestor") -> DataFrame:
    """Edges or paths both of whose ends are used terms."""
    ids = used.select("gonum").distinct()
    return graph.join(ids.withColumnRenamed("gonum", a), a, "left_semi").join(ids.withColumnRenamed("gonum", b), b, "left_semi")


def slim(terms: DataFrame, subset: DataFrame) -> DataFrame:
    flag = subset.select("gonum", F.lit(True).alias("is_slim")).distinct()
    return terms.join(flag, "gonum", "left").fillna(False, ["is_slim"])


def evidence_columns(terms: DataFrame) -> DataFrame:
    """Per gonum and category the codes assigned, then in brackets those only inherited, each group in alphabetical order."""
    code = F.regexp_replace("ec", "[()]", "")
    rows = terms.select("gonum", code.alias("ec"), ~F.col("ec").startswith("(")).toDF("gonum", "ec", "own")
    out = []
    for name, codes in EVIDENCE.items():
        here = F.when(F.col("ec").isin(*codes), F.col("ec"))
        own = F.sort_array(F.collect_set(F.when(F.col("own"), here)))
        more = F.array_except(F.sort_array(F.collect_set(F.when(~F.col("own"), here))), own)
        out.append(F.concat_ws(",", own, F.transform(more, lambda x: F.concat(F.lit("("), x, F.lit(")")))).alias(name))
    return rows.groupBy("gonum").agg(*out)


def terms_per_group(members: DataFrame, seq_terms: DataFrame, terms: DataFrame, domain: str | None = None, level: tuple | None = None, evalue: float | None = None, above: int = 0) -> DataFrame:
    """gonum, name, domain, level, n_groups: each term counted once per group (cluster, pair or sequence).
    ``members`` has group, seq_id; ``level`` is (lowest, highest)."""
    rows = seq_terms if evalue is None else seq_terms.where(F.col("evalue") <= evalue)
    counts = members.join(rows, "seq_id").select("group", "gonum").distinct().groupBy("gonum").agg(F.count(F.lit(1)).alias("n_groups")).where(F.col("n_groups") > above)
    kept = terms if domain is None else terms.where(F.col("domain") == domain)
    if level:
        kept = kept.where(F.col("level").between(*level))
    return counts.join(kept, "gonum").select("gonum", "name", "domain", "level", "n_groups")


def ancestors(paths: DataFrame, terms: DataFrame, start: DataFrame) -> DataFrame:
    """start, gonum, level for every ancestor of each start term, by level then id. ``paths`` has no rel 3 steps."""
    rows = start.select(F.col("gonum").alias("start")).join(paths, F.col("start") == F.col("child")).where("ancestor <> start")
    return rows.select("start", F.col("ancestor").alias("gonum")).distinct().join(terms.select("gonum", "level"), "gonum").select("start", "gonum", "level").orderBy("start", "level", "gonum")


def descendants(paths: DataFrame, terms: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """start, gonum, level, replaced: descendants, or where a term has none, the term that replaces it."""
    own = start.select(F.col("gonum").alias("start"))
    rows = own.join(paths, F.col("start") == F.col("ancestor")).select("start", F.col("child").alias("gonum")).distinct()
    lone = own.join(rows.select("start").distinct(), "start", "left_anti")
    instead = lone.join(edges.where(F.col("rel") == REPLACED), F.col("start") == F.col("child")).select("start", F.col("parent").alias("gonum"))
    both = rows.withColumn("replaced", F.lit(False)).unionByName(instead.withColumn("replaced", F.lit(True)))
    return both.join(terms.select("gonum", "level"), "gonum").select("start", "gonum", "level", "replaced")


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """start, gonum, side (parent or child) and relation: is_a, part_of, both, or replaced by / alternate."""
    own = start.select(F.col("gonum").alias("start")).distinct()
    up = own.join(edges, F.col("start") == F.col("child")).select("start", F.col("parent").alias("gonum"), F.lit("parent").alias("side"), "rel")
    down = own.join(edges, F.col("start") == F.col("parent")).select("start", F.col("child").alias("gonum"), F.lit("child").alias("side"), "rel")
    rows = up.unionByName(down).groupBy("start", "gonum", "side").agg(F.sort_array(F.collect_set("rel")).alias("_r"))
    has = lambda n: F.array_contains("_r", n)
    name = (
        F.when(has(REPLACED), F.when(F.col("side") == "parent", "replaced by").otherwise("alternate"))
        .when(has(1) & has(2), "both").when(has(1), "is_a").otherwise("part_of")
    )
    return rows.select("start", "gonum", "side", name.alias("relation"))


def inheriting_hits(direct: DataFrame, paths: DataFrame, terms: DataFrame, start: DataFrame) -> DataFrame:
    """start, hit_id, via: hits of descendants, each once with its first descendant by level and id."""
    rows = start.select(F.col("gonum").alias("start")).join(paths, F.col("start") == F.col("ancestor")).join(direct, F.col("child") == F.col("gonum"))
    rows = rows.join(terms.select(F.col("gonum").alias("child"), "level"), "child")
    return rows.groupBy("start", "hit_id").agg(F.min_by("child", F.struct("level", "child")).alias("via"))


def root_paths(edges: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """start and path (from the root to the start) for every way up without rel 3."""
    steps = cut(edges.where(F.col("rel") != REPLACED).select("child", "parent").distinct())
    front = start.select(F.col("gonum").alias("start"), F.array("gonum").alias("path")).distinct()
    done = None
    for _ in range(most):
        up = front.join(steps.hint("merge"), F.element_at("path", 1) == F.col("child"), "left")
        over = up.where(F.col("parent").isNull()).select("start", "path")
        done = over if done is None else done.unionByName(over)
        front = cut(up.where(F.col("parent").isNotNull() & ~F.expr("array_contains(path, parent)")).select("start", F.concat(F.array("parent"), "path").alias("path")))
        if not front.head(1):
            return cut(done)
    raise ValueError("the graph has a cycle")


def longest_paths(paths: DataFrame) -> DataFrame:
    """Paths of a start that are not an ordered part of a longer one. Containment is counted by matching the shorter
    path's terms one after the other along the longer."""
    a, b = paths.select("start", F.col("path").alias("a")), paths.select("start", F.col("path").alias("b"))
    matched = F.aggregate("b", F.lit(0), lambda n, x: F.when((n < F.size("a")) & (F.get("a", n) == x), n + 1).otherwise(n))
    inside = a.join(b, "start").where((F.size("a") < F.size("b")) & (matched == F.size("a"))).select("start", F.col("a").alias("path"))
    return paths.join(inside, ["start", "path"], "left_anti")


def _top_down(up: dict, start: object) -> list | None:
    """The terms above a start and itself, each behind all its parents; None where there is a cycle."""
    done, on_way, order, stack = set(), set(), [], [(start, False)]
    while stack:
        node, left = stack.pop()
        if left:
            on_way.discard(node)
            done.add(node)
            order.append(node)
        elif node in on_way:
            return None
        elif node not in done:
            on_way.add(node)
            stack.append((node, True))
            stack += [(p, False) for p in up[node] if p not in done]
    return order


def _without_detours(up: dict, order: list) -> dict:
    """Each term's parents but for those that are an ancestor of another of its parents. ``order`` has parents first."""
    bit = {x: 1 << i for i, x in enumerate(order)}
    above, kept = {}, {}
    for x in order:
        far = 0
        for p in up[x]:
            far |= above[p]
        above[x] = far
        kept[x] = [p for p in up[x] if not far & bit[p]]
        for p in up[x]:
            above[x] |= bit[p]
    return kept


def _ways_up(up: dict, start: object) -> Iterator[list]:
    """Every way from a start to a term without parents, from the latter down; a term comes once in a way."""
    way, stack = [], [(start, 0)]
    while stack:
        node, depth = stack.pop()
        del way[depth:]
        if node in way:
            continue
        way.append(node)
        if up[node]:
            stack += [(p, depth + 1) for p in up[node]]
        else:
            yield way[::-1]


def _part_of(a: list, b: list) -> bool:
    rest = iter(b)
    return len(a) < len(b) and all(x in rest for x in a)


def longest_root_paths(edges: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """What ``longest_paths`` of ``root_paths`` gives, without comparing paths: a path is an ordered part of a longer one if
    one of its steps can be replaced by a detour, so the others are the paths over steps without one.

    Rounds gather the terms above each start with their parents, each once for a start however many paths meet in it; a task
    takes the steps with detours out of a start's graph and unfolds its paths one after the other. Only where there is a
    cycle are a start's paths compared with each other."""
    kind = dict(edges.dtypes)["parent"]
    up = cut(edges.where(F.col("rel") != REPLACED).groupBy("child").agg(F.collect_set("parent").alias("_up")))
    front = start.select(F.col("gonum").alias("start"), F.col("gonum").cast(kind).alias("node")).distinct()
    known = None
    for n in range(1, most + 2):
        if n > most or n >= 8 and n & (n - 1) == 0:
            front = front.join(known.select("start", "node").hint("merge"), ["start", "node"], "left_anti")
        found = cut(front.join(up.hint("merge"), F.col("node") == F.col("child"), "left").select("start", "node", "_up"))
        known = found if known is None else known.unionByName(found)
        front = found.select("start", F.explode("_up").alias("node")).distinct()
        if not found.where("size(_up) > 0").head(1):
            break
    else:
        raise ValueError("the graph has a cycle")
    graph = known.groupBy("start").agg(F.collect_list(F.struct("node", F.coalesce("_up", F.array().cast(f"array<{kind}>")).alias("up"))).alias("_g"))
    names = pa.schema([("start", to_arrow_type(start.schema["gonum"].dataType)), ("path", pa.list_(to_arrow_type(edges.schema["parent"].dataType)))])

    def batch(starts: list, ends: list, terms: list) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, names.field("path").type.value_type))
        return pa.RecordBatch.from_arrays([pa.array(starts, names.field("start").type), lists.cast(names.field("path").type)], schema=names)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ends, terms = [], [0], []
        for rows in batches:
            for i in range(rows.num_rows):
                first = rows.column(0)[i].as_py()
                above = dict(zip(rows.column(1)[i].as_py(), rows.column(2)[i].as_py(), strict=True))
                order = _top_down(above, first)
                if order is None:
                    all_ = list(_ways_up(above, first))
                    ways = (a for a in all_ if not any(_part_of(a, b) for b in all_))
                else:
                    ways = _ways_up(_without_detours(above, order), first)
                for way in ways:
                    starts.append(first)
                    terms += way
                    ends.append(len(terms))
                    if len(terms) >= HELD_TERMS:
                        yield batch(starts, ends, terms)
                        starts, ends, terms = [], [0], []
        if starts:
            yield batch(starts, ends, terms)

    columns = graph.select("start", F.col("_g.node").alias("nodes"), F.col("_g.up").alias("ups"))
    return columns.mapInArrow(unfold, f"start {dict(start.dtypes)['gonum']}, path array<{kind}>")


def terminal_terms(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of a table of terms of which no descendant is in the table."""
    ids = table.select("gonum").distinct()
    above = paths.join(ids.withColumnRenamed("gonum", "child"), "child", "left_semi").where("child <> ancestor").select(F.col("ancestor").alias("gonum"))
    return table.join(above, "gonum", "left_anti")


def related_in_table(table: DataFrame, paths: DataFrame, start: DataFrame) -> DataFrame:
    """Rows that are an ancestor or a descendant of a start term, or one itself."""
    own = start.select("gonum")
    up = paths.join(own.withColumnRenamed("gonum", "child"), "child", "left_semi").select(F.col("ancestor").alias("gonum"))
    down = paths.join(own.withColumnRenamed("gonum", "ancestor"), "ancestor", "left_semi").select(F.col("child").alias("gonum"))
    return table.join(own.unionByName(up).unionByName(down).distinct(), "gonum", "left_semi")


def marked_ancestors(table: DataFrame, paths: DataFrame) -> DataFrame:
    """All ancestors of the terms of a table, each once; members of the table are marked with ``*``."""
    ids = table.select("gonum").distinct()
    up = paths.join(ids.withColumnRenamed("gonum", "child"), "child", "left_semi").select(F.col("ancestor").alias("gonum")).distinct()
    return up.join(ids.withColumn("_in", F.lit("*")), "gonum", "left").select("gonum", F.coalesce("_in", F.lit("")).alias("mark"))


def merged_graph(graphs: list[DataFrame]) -> DataFrame:
    """Rows of several datasets' term tables, the first dataset's where a gonum repeats."""
    rows = graphs[0].withColumn("_at", F.lit(0))
    for i, g in enumerate(graphs[1:], 1):
        rows = rows.unionByName(g.withColumn("_at", F.lit(i)))
    columns = [c for c in graphs[0].columns if c != "gonum"]
    best = rows.groupBy("gonum").agg(F.min_by(F.struct(*columns), "_at").alias("_r"))
    return best.select("gonum", *[F.col(f"_r.{c}").alias(c) for c in columns])


def terms_of_hits(terms: DataFrame, info: DataFrame, inherited: bool = False) -> DataFrame:
    """hit_id, gonum, domain, level, ec of the terms of hits: assigned ones, or with those inherited, each once."""
    rows = terms if inherited else terms.where("is_direct")
    return rows.join(info.select("gonum", "domain", "level"), "gonum").select("hit_id", "gonum", "domain", "level", "ec")


def holders(seq_terms: DataFrame, start: DataFrame) -> DataFrame:
    """start, seq_id, evalue of the sequences that have a term, best first by rank."""
    rows = seq_terms.join(start.select("gonum").distinct(), "gonum", "left_semi")
    place = F.row_number().over(Window.partitionBy("gonum").orderBy("evalue", "seq_id"))
    return rows.select(F.col("gonum").alias("start"), "seq_id", "evalue", place.alias("place"))


def expressed(values: DataFrame, cutoffs: dict[str, float], how: str = "any", direction: str = "either") -> DataFrame:
    """seq_id of sequences that are differentially expressed: the p-value is nearer to 0 than the column's cutoff, in ``any``
    or ``all`` of the columns, and of the sign that ``direction`` (up, down, either) asks for. ``values`` has column, seq_id,
    p; a null p is above any cutoff."""
    p = F.col("p")
    sign = {"up": p > 0, "down": p < 0, "either": F.lit(True)}[direction]
    below = F.lit(False)
    for column, cutoff in cutoffs.items():
        below = below | ((F.col("column") == column) & (F.abs(p) < cutoff))
    enough = 1 if how == "any" else len(cutoffs)
    return values.where(below & sign).groupBy("seq_id").agg(F.countDistinct("column").alias("_n")).where(F.col("_n") >= enough).select("seq_id")


def recounted(seq_terms: DataFrame, values: DataFrame, cutoffs: dict[str, float], how: str = "any", direction: str = "either", least: int = 1) -> DataFrame:
    """gonum, n_seqs: for each term its sequences that are ``expressed``, terms with fewer than ``least`` left out."""
    rows = seq_terms.select("seq_id", "gonum").distinct().join(expressed(values, cutoffs, how, direction), "seq_id", "left_semi")
    return rows.groupBy("gonum").agg(F.count(F.lit(1)).alias("n_seqs")).where(F.col("n_seqs") >= least)


def recounted_hits(hits: DataFrame, direct: DataFrame, paths: DataFrame, values: DataFrame, cutoffs: dict[str, float], how: str = "any", direction: str = "either", least: int = 1) -> DataFrame:
    """What ``recounted`` of ``sequence_terms`` gives: sequences are chosen first, and the terms of a sequence are only counted,
    each once, so that rows of sequences and terms are made for chosen ones alone and no best hit is sought among them."""
    terms = _terms_of_hits(direct, paths).select("hit_id", F.concat("_own", "_above").alias("_all"))
    # Twice the usual number of partitions, as in sequence_terms.
    n = 2 * int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = hits.select("seq_id", "hit_id").join(expressed(values, cutoffs, how, direction), "seq_id", "left_semi")
    rows = own.join(terms, "hit_id").repartition(n, "seq_id").groupBy("seq_id").agg(F.array_distinct(F.flatten(F.collect_list("_all"))).alias("_all"))
    counts = rows.select(F.explode("_all").alias("gonum")).groupBy("gonum").agg(F.count(F.lit(1)).alias("n_seqs"))
    return counts.where(F.col("n_seqs") >= least)


#: What an entry of the protein database adds to a hit.
CROSS_REFERENCES = ("go_list", "interpro", "kegg", "pfam", "ec")


def annotated(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct hits with the cross-references of the entry of their id: go_list, interpro, kegg, pfam, ec; empty texts where
    an entry has none or there is no entry. ``entries`` has hit_id and these columns, one row for each id (of repeated ones
    the least row counts)."""
    columns = [c for c in CROSS_REFERENCES if c in entries.columns]
    one = entries.groupBy("hit_id").agg(F.min(F.struct(*columns)).alias("_e"))
    rows = hits.dropDuplicates(["hit_id"]).drop(*columns).join(one, "hit_id", "left")
    return rows.select(*[c for c in rows.columns if c != "_e"], *[F.coalesce(F.col(f"_e.{c}"), F.lit("")).alias(c) for c in columns])


def annotation_counts(hits: DataFrame) -> DataFrame:
    """kind and n_hits: hits with each kind of cross-reference, in one pass."""
    columns = [c for c in CROSS_REFERENCES if c in hits.columns]
    sums = hits.agg(*[F.sum((F.col(c) != "").cast("long")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit(0)).alias("n_hits")) for c in columns])).alias("_r")).select("_r.*")
