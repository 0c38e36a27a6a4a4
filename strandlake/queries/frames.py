"""The choice of reading frames around hits, on texts turned to nucleotides, with SQL that walks codons as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import frame_pairs as FP
from strandlake.operators import merge as M
from strandlake.operators import orf as O
from strandlake.operators import orf_choice as C
from strandlake.queries import roles as R
from strandlake.queries.roles import rounded
from strandlake.queries.sequences import ALPHABET, count

STOPS = "('TAA', 'TAG', 'TGA')"


DNA_SQL = f"""dna AS (SELECT * FROM (SELECT conv_id * 10 + turn AS seq_id, min(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), {ALPHABET})) AS seq FROM conversations GROUP BY 1) WHERE len(seq) >= 15)"""


def dna(spark, sf):
    """Turns of conversations as sequences."""
    text = F.expr(f"translate(regexp_replace(lower(text), '[^a-z]', ''), {ALPHABET})")
    rows = R.read(spark, sf, "conversations").groupBy((F.col("conv_id") * 10 + F.col("turn")).alias("seq_id"))
    return rows.agg(F.min(text).alias("seq")).where(F.length("seq") >= 15)


def hits(spark, sf):
    """Two hits of each sequence. A third of them begin at an ATG, half of these end before its stop; a fifth are on the
    other strand; some are of nucleotides, in several frames, or poor."""
    two = dna(spark, sf).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"len": F.length("seq"), "atg": F.instr("seq", "ATG")})
    places = F.expr(f"filter(sequence(greatest(atg, 1), greatest(len - 2, atg, 1), 3), i -> substring(seq, i, 3) IN {STOPS})")
    rows = two.withColumn("stop", F.try_element_at(places, F.lit(1)))
    at_atg = (F.col("seq_id") % 3 == 0) & (F.col("n") == 0) & (F.col("atg") > 0) & F.col("stop").isNotNull()
    start = F.when(at_atg, F.col("atg")).otherwise(1 + (F.col("seq_id") * 7 + F.col("n") * 5) % F.floor(F.col("len") / 2)).cast("int")
    rows = rows.withColumn("hs", start)
    end = F.when(at_atg & (F.col("seq_id") % 6 == 0), F.col("stop") - 1).otherwise(F.least(F.col("hs") + 3 * (5 + F.col("seq_id") % 9) - 1, F.col("len"))).cast("int")
    rows = rows.withColumn("he", end)
    turned = F.col("seq_id") % 5 == 4
    on = lambda c: F.when(turned, F.col("len") - F.col(c) + 1).otherwise(F.col(c))
    i = F.col("seq_id")
    return rows.select(
        "seq_id", F.col("n").alias("hit_id"), ((F.col("n") > 0) | (i % 7 > 0)).alias("is_aa"), (F.col("n") == 0).alias("best_bits"), (F.col("n") == 1).alias("best_anno"), (i % 8 == 1).alias("multi_frame"),
        F.when((F.col("n") == 0) & (i % 4 > 0), 1e-20).otherwise(0.001).alias("evalue"), (i * 13 % 60).alias("sim"), (i * 11 % 100).alias("seq_cov"), (i * 17 % 100).alias("hit_cov"), on("hs").alias("seq_start"), on("he").alias("seq_end"),
    )


def hit_quality(spark, sf):
    return C.hit_choice(hits(spark, sf), dna(spark, sf))


def found(spark, sf):
    return C.candidates(dna(spark, sf), hit_quality(spark, sf))


def hit_orfs(spark, sf):
    """Candidates of all frames, those of good hits' frames from the hits' regions."""
    return found(spark, sf).select("seq_id", "frame", "start", "end", "has_start", "has_stop", "after_stop", "anno")


def close_starts(spark, sf):
    return C.without_close_starts(found(spark, sf)).select("seq_id", "frame", "start", "end", "has_start", "has_stop", "after_stop")


def best_orfs(spark, sf):
    rows = found(spark, sf)
    scores = O.markov_scores(rows.where("has_start AND has_stop"), O.base_frequencies(dna(spark, sf)))
    best = C.best_orfs(C.with_markov(C.without_close_starts(rows), scores))
    return rounded(best.select("seq_id", "frame", "start", "end", "has_start", "has_stop", "anno", "good_hit", "markov"), "markov")


def training_set(spark, sf):
    """The longest whole texts, without those like a longer one, until 300 are found and 200,000 letters."""
    rows = dna(spark, sf).withColumnRenamed("seq", "orf")
    return C.training_set(rows, most=300, most_bases=200_000, round_rows=128).select("seq_id")


def region_totals(spark, sf):
    """Around the hits' regions as coding ones."""
    seqs = dna(spark, sf).join(hit_quality(spark, sf), "seq_id").withColumnsRenamed({"hit_start": "start", "hit_end": "end"})
    return FP.region_totals(FP.regions(seqs))


def instantiated(spark, sf):
    reads = dna(spark, sf).withColumn("name", F.concat(F.lit("r"), F.lpad(F.col("seq_id").cast("string"), 9, "0")))
    rows, members = M.instantiated(reads, "tw")
    return rows.join(members, ["seq_name", "name"]).select("seq_name", "name", "len", "n_reads", "orientation", "percent_aligned")


HIT_SQL = f"""{DNA_SQL}, h2 AS (SELECT *, len(seq) AS len, instr(seq, 'ATG') AS atg FROM dna, (SELECT unnest([0, 1]) AS n)),
h3 AS (SELECT *, list_filter(range(greatest(atg, 1), greatest(len - 1, atg, 1), 3), lambda i: substr(seq, i, 3) IN {STOPS})[1] AS stop FROM h2),
h4 AS (SELECT *, seq_id % 3 = 0 AND n = 0 AND atg > 0 AND stop IS NOT NULL AS at_atg FROM h3),
h5 AS (SELECT *, CASE WHEN at_atg THEN atg ELSE 1 + (seq_id * 7 + n * 5) % (len // 2) END AS hs FROM h4),
h6 AS (SELECT *, CASE WHEN at_atg AND seq_id % 6 = 0 THEN stop - 1 ELSE least(hs + 3 * (5 + seq_id % 9) - 1, len) END AS he, row_number() OVER (PARTITION BY seq_id ORDER BY n) AS r FROM h5 WHERE n > 0 OR seq_id % 7 > 0),
h7 AS (SELECT *, CASE WHEN seq_id % 5 = 4 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS s, seq_id * 13 % 60 AS sim, seq_id * 11 % 100 AS seq_cov, seq_id * 17 % 100 AS hit_cov FROM h6 WHERE r = 1),
h8 AS (SELECT *, CASE WHEN seq_id % 5 = 4 AND he <= hs THEN len - hs + 1 ELSE hs END AS a, CASE WHEN seq_id % 5 = 4 AND he <= hs THEN len - he + 1 ELSE he END AS b FROM h7),
hc AS (SELECT seq_id, CAST(((a + 2) % 3 + 1) * CASE WHEN seq_id % 5 = 4 THEN -1 ELSE 1 END AS INT) AS frame, CAST(a AS INT) AS hit_start, CAST(b AS INT) AS hit_end,
  CAST(len(list_filter(range(a, b - 2, 3), lambda i: substr(s, i, 3) IN {STOPS})) AS INT) AS n_stops,
  ((n = 0 AND seq_id % 4 > 0) OR sim >= 20) AND NOT (seq_id % 8 = 1 AND greatest(sim, seq_cov, hit_cov) < 40) AS good_hit, hit_cov >= 95 AND sim >= 60 AS great_hit FROM h8)"""

CANDIDATE_SQL = f"""{HIT_SQL},
strand AS (SELECT seq_id, CAST(f AS INT) AS frame, len(seq) AS len, CASE WHEN len(seq) <= 30 THEN 9 ELSE 30 END AS least, CASE WHEN f > 0 THEN seq ELSE translate(reverse(seq), 'ACGT', 'TGCA') END AS s FROM dna, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS f)),
side AS (SELECT s.*, hc.* EXCLUDE (seq_id, frame), coalesce(hc.good_hit AND n_stops = 0, false) AS guided FROM strand s LEFT JOIN hc USING (seq_id, frame)),
codon AS (SELECT *, c IN {STOPS} AS stop, c = 'ATG' AS is_atg FROM (SELECT *, substr(s, p, 3) AS c FROM (SELECT *, unnest(range(abs(frame), len - 1, 3)) AS p FROM side))),
piece AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY seq_id, frame ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k, sum(CAST(stop AS INT)) OVER (PARTITION BY seq_id, frame) AS stops FROM codon WHERE NOT guided),
g AS (SELECT seq_id, frame, k, any_value(stops) AS stops, any_value(len) AS len, min(p) AS first, min(p) FILTER (is_atg) AS atg, max(p + 2) FILTER (stop) AS stop_end FROM piece GROUP BY ALL),
u AS (SELECT *, coalesce((SELECT min(p + 2) FILTER (substr(s, p, 3) IN {STOPS}) FROM (SELECT unnest(range(hit_end - 2, len - 1, 3)) AS p)), 0) AS down, substr(s, hit_start, 3) = 'ATG' AS begins FROM side WHERE guided),
v AS (SELECT *, CASE WHEN down > 0 THEN down ELSE len END AS till, begins AND substr(s, hit_end + 1, 3) IN {STOPS} AS exact, coalesce((SELECT max(p) FILTER (substr(s, p, 3) IN {STOPS}) FROM (SELECT unnest(range(hit_start, 0, -3)) AS p)), 0) AS up FROM u),
w AS (SELECT *, NOT exact AND begins AND till - hit_start + 1 > least AS from_start,
  list_filter(range(hit_start, greatest(up, 0), -3), lambda p: substr(s, p, 3) = 'ATG') AS ups, list_filter(range(hit_start, least(hit_start + 30, len - 1), 3), lambda p: substr(s, p, 3) = 'ATG')[1] AS inner_atg FROM v),
o AS (SELECT * FROM w WHERE NOT exact AND NOT from_start),
raw AS (SELECT DISTINCT * FROM (
  SELECT seq_id, frame, first AS a, coalesce(stop_end, len) AS b, false AS has_start, stop_end IS NOT NULL AS has_stop, k > 0 AS after_stop FROM g WHERE CASE WHEN stops = 0 THEN atg IS NULL OR atg > 10 ELSE atg IS DISTINCT FROM first END
  UNION ALL SELECT seq_id, frame, atg, coalesce(stop_end, len), true, stop_end IS NOT NULL, false FROM g WHERE atg IS NOT NULL
  UNION ALL SELECT seq_id, frame, hit_start, hit_end + 3, true, true, false FROM w WHERE exact
  UNION ALL SELECT seq_id, frame, hit_start, till, true, down > 0, false FROM w WHERE from_start
  UNION ALL SELECT seq_id, frame, unnest(ups), till, true, down > 0, false FROM o
  UNION ALL SELECT seq_id, frame, up + 3, till, false, down > 0, true FROM o WHERE up > 0
  UNION ALL SELECT seq_id, frame, inner_atg, till, true, down > 0, false FROM o WHERE len(ups) = 0 AND inner_atg IS NOT NULL
  UNION ALL SELECT seq_id, frame, hit_start, hit_end, false, false, false FROM o WHERE len(ups) = 0 AND inner_atg IS NULL AND down = 0
  UNION ALL SELECT seq_id, frame, abs(frame), till, false, down > 0, false FROM o WHERE up = 0)),
cand AS MATERIALIZED (SELECT r.seq_id, r.frame, CAST(a AS INT) AS start, CAST(b - (b - a + 1) % 3 AS INT) AS "end", has_start, has_stop, after_stop,
  coalesce(s.hit_start <= b - (b - a + 1) % 3 AND s.hit_end >= a, false) AS anno, coalesce(h.good_hit, false) AS good_hit, abs((b - a + 1) - (b - a + 1) % 3 - s.len) <= 3 AS "full", substr(s.s, a, b - a + 1 - (b - a + 1) % 3) AS orf
  FROM raw r JOIN side s USING (seq_id, frame) LEFT JOIN hc h ON h.seq_id = r.seq_id WHERE b - a + 1 > s.least)"""

NUMBERED_SQL = "row_number() OVER (PARTITION BY seq_id, frame ORDER BY start, has_start DESC, \"end\")"
PRUNED_SQL = f"""{CANDIDATE_SQL}, num AS MATERIALIZED (SELECT *, {NUMBERED_SQL} AS n FROM cand),
walk AS (SELECT seq_id, frame, n, n AS last, CAST(NULL AS BIGINT) AS gone FROM num WHERE n = 1 UNION ALL
  SELECT seq_id, frame, n, CASE WHEN later THEN last ELSE n END, CASE WHEN later THEN n WHEN NOT later THEN last END FROM (
    SELECT x.seq_id, x.frame, x.n, w.last, CASE WHEN x.start - l.start < 120 AND l.has_start AND x.after_stop THEN true WHEN x.start - l.start < 120 AND l.after_stop AND x.has_start THEN false
      WHEN x.start - l.start < 30 THEN CASE WHEN l.has_start <> x.has_start THEN l.has_start ELSE x.start > l.start END END AS later
    FROM walk w JOIN num x ON x.seq_id = w.seq_id AND x.frame = w.frame AND x.n = w.n + 1 JOIN num l ON l.seq_id = w.seq_id AND l.frame = w.frame AND l.n = w.last)),
pruned AS MATERIALIZED (SELECT * EXCLUDE (n) FROM num WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.seq_id = num.seq_id AND w.frame = num.frame AND w.gone = num.n))"""


def order_sql(x: str, y: str) -> str:
    flag = lambda c: f"CASE WHEN {c.format(x)} AND NOT {c.format(y)} THEN -1 WHEN NOT {c.format(x)} AND {c.format(y)} THEN 1 END"
    by_len, by_mk = f"({y}.size - {x}.size)", f"CAST(trunc({y}.markov - {x}.markov) AS INT)"
    len_gap, mk_gap = f"abs({x}.log_len - {y}.log_len)", f"abs({x}.log_mk - {y}.log_mk)"
    full = f"{x}.\"full\" AND {y}.\"full\" AND {x}.frame = 1"
    return f"""coalesce(CASE WHEN {full} THEN {flag('({0}.anno AND {0}.has_start)')} END, CASE WHEN {full} AND NOT {x}.anno AND NOT {y}.anno THEN {flag('{0}.has_start')} END, CASE WHEN {x}.good_hit THEN {flag('{0}.anno')} END,
      CASE WHEN greatest({x}.size, {y}.size) > 100 AND {len_gap} > 0.4 THEN {by_len} WHEN greatest({x}.markov, {y}.markov) > 10 AND {mk_gap} > 0.3 THEN {by_mk} WHEN {len_gap} > 0.4 THEN {by_len} WHEN {mk_gap} > 0.3 THEN {by_mk} END,
      {flag('({0}.has_start AND {0}.has_stop)')}, CASE WHEN {x}.has_start AND {y}.after_stop THEN -1 WHEN {x}.after_stop AND {y}.has_start THEN 1 END, {flag('{0}.anno')}, CASE WHEN {len_gap} < {mk_gap} THEN {by_mk} ELSE {by_len} END)"""


def fold_sql(name: str, rows: str, keys: str, order: str) -> str:
    on = lambda a: " AND ".join(f"{a}.{k} = w.{k}" for k in keys.split(", "))
    first = ", ".join(f"w.{k}" for k in keys.split(", "))
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {rows}),
{name}_w AS (SELECT {keys}, n, n AS best FROM {name}_n WHERE n = 1 UNION ALL SELECT {first}, x.n, CASE WHEN {order_sql('b', 'x')} > 0 THEN x.n ELSE b.n END FROM {name}_w w JOIN {name}_n x ON {on('x')} AND x.n = w.n + 1 JOIN {name}_n b ON {on('b')} AND b.n = w.best),
{name} AS MATERIALIZED (SELECT b.* EXCLUDE (n) FROM (SELECT {keys}, arg_max(best, n) AS best FROM {name}_w GROUP BY ALL) w JOIN {name}_n b ON {on('b')} AND b.n = w.best)"""


MARKOV_SQL = f"""k AS (SELECT substr(orf, i, 6) AS kmer, (i + 4) % 3 AS phase FROM (SELECT orf, unnest(range(1, len(orf) - 4)) AS i FROM cand WHERE has_start AND has_stop)),
f AS (SELECT kmer, phase, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY ALL), p AS (SELECT kmer[:5] AS pre, phase, sum(n) AS p FROM f GROUP BY ALL), b AS (SELECT sum({count('AT')}) AS n_at, sum({count('GC')}) AS n_gc FROM dna),
sc AS MATERIALIZED (SELECT kmer, phase, ln((n + 1) / (p + 4) / (CASE WHEN kmer[6] IN ('A', 'T') THEN n_at ELSE n_gc END / 2 / (n_at + n_gc))) AS score FROM f JOIN p USING (phase), b WHERE pre = kmer[:5]),
texts AS (SELECT orf, unnest(range(1, len(orf) - 4)) AS i FROM (SELECT DISTINCT orf FROM pruned)),
sums AS (SELECT orf, sum(score) AS markov FROM texts JOIN sc ON kmer = substr(orf, i, 6) AND phase = (i + 4) % 3 GROUP BY 1),
scored AS MATERIALIZED (SELECT *, CASE WHEN abs(markov) < 1 THEN 0.01 ELSE ln(abs(markov)) END * CASE WHEN markov < 0 THEN -1 ELSE 1 END AS log_mk, len(orf) AS size,
  ln(len(orf) - CASE WHEN contains(orf, 'NNNNNNNNN') THEN {count('N', 'orf')} ELSE 0 END) AS log_len FROM (SELECT p.*, coalesce(s.markov, 0) AS markov FROM pruned p LEFT JOIN sums s USING (orf)))"""

QUERIES = {
    "q12_hit_quality": (hit_quality, f"WITH {HIT_SQL} SELECT * FROM hc"),
    "q08_q09_hit_orfs": (hit_orfs, f"WITH {CANDIDATE_SQL} SELECT seq_id, frame, start, \"end\", has_start, has_stop, after_stop, anno FROM cand"),
    "q10_close_starts": (close_starts, f"WITH RECURSIVE {PRUNED_SQL} SELECT seq_id, frame, start, \"end\", has_start, has_stop, after_stop FROM pruned"),
    "q11_q16_best_orfs": (best_orfs, f"""WITH RECURSIVE {PRUNED_SQL}, {MARKOV_SQL}, {fold_sql('one', 'scored', 'seq_id, frame', 'start, has_start DESC, "end"')}, {fold_sql('best', 'one', 'seq_id', 'frame')}
        SELECT seq_id, frame, start, "end", has_start, has_stop, anno, good_hit, round(markov, 6) AS markov FROM best"""),
    "q13_training_set": (training_set, None),
    "a15_q04_region_totals": (region_totals, f"""WITH {HIT_SQL}, t AS (SELECT hit_start AS a, hit_end AS b, CASE WHEN frame < 0 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS s FROM dna JOIN hc USING (seq_id)),
        r AS (SELECT 'utr5' AS region, substr(s, 1, a - 1) AS t FROM t UNION ALL SELECT 'cds', substr(s, a, b - a + 1) FROM t UNION ALL SELECT 'utr3', substr(s, b + 1) FROM t),
        g AS (SELECT region, CAST((i - 1) % 3 + 1 AS INT) AS j, count(*) AS n FROM (SELECT region, t, unnest(range(1, (len(t) - 1) // 3 * 3 + 1)) AS i FROM r WHERE region = 'cds') WHERE t[i] IN ('G', 'C') GROUP BY ALL)
        SELECT region, count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS bases, CAST(sum({count('C', 't')}) AS BIGINT) AS c, CAST(sum({count('G', 't')}) AS BIGINT) AS g, CAST(sum(len(regexp_extract_all(t, 'CG'))) AS BIGINT) AS cpg,
          """ + ", ".join(f"(SELECT n FROM g WHERE g.region = r.region AND j = {j}) AS gc{j}" for j in (1, 2, 3)) + " FROM r GROUP BY region"),
    "e04_instantiated": (instantiated, f"""WITH {DNA_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY seq_id) AS r, len(CAST(count(*) OVER () AS VARCHAR)) AS w FROM dna)
        SELECT 'tw_' || lpad(CAST(r AS VARCHAR), CAST(w AS INT), '0') AS seq_name, 'r' || lpad(CAST(seq_id AS VARCHAR), 9, '0') AS name, CAST(len(seq) AS INT) AS len, 1 AS n_reads, 'U' AS orientation, 100 AS percent_aligned FROM n"""),
}
