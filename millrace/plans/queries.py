"""One query for each operator family over the driver's tables, and its SQL.

The tables carry no programs or decks, so columns stand in: ``lang`` or
``source`` for the band, whole texts for sources, lines for cards, labels for
predictions.  Every query reads whole tables; a limit is there only where the
operator is a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import deck as D
from millrace.functions import hashing as H
from millrace.functions import taxonomy as X
from millrace.functions import text as T
from millrace.functions.python import depth_bucket, edit_distance, tree_columns
from millrace.operators import admit as A
from millrace.operators import dedupe, monitor, report, retrieve, review, sample, sft, split
from millrace.plans import corpus, curriculum, evaluate, reviews
from millrace.session import shared_folder
from millrace.sources import records
from millrace.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").withColumn("alpha", F.sha2("text", 256))


def _scored(spark, d):
    """documents joined to labels as predictions: quality is exact, toxic is functional."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    both = docs.join(labels, "doc_id")
    return both.select(
        "doc_id", "lang", "source", "text", F.col("n_chars"), (F.col("quality") == 1).alias("exact_match"), (F.col("toxic") == 1).alias("functional"),
        (F.col("quality") + F.col("toxic") > 0).alias("assemblable"), (F.col("n_chars") % 101 / F.lit(101.0)).alias("per_card_exact"),
        (F.col("n_chars") % 97 / F.lit(97.0)).alias("normalized_edit_distance"), (F.col("n_chars") % 13).alias("diff_count"),
    )


_SCORED = """scored as (select d.doc_id, d.lang, d.source, d.text, d.n_chars, l.quality = 1 as exact_match, l.toxic = 1 as functional,
  l.quality + l.toxic > 0 as assemblable, (d.n_chars % 101) / 101.0::double as per_card_exact,
  (d.n_chars % 97) / 97.0::double as normalized_edit_distance, d.n_chars % 13 as diff_count
  from documents d join labels l using (doc_id))"""

_UNIT = "cast(('0x' || substr(sha256(sha256(text)), 1, 8)) as ubigint)::double / 4294967295.0::double"


@query(f"select doc_id, {_UNIT} as u, case when {_UNIT} < 0.8::double then 'train' when {_UNIT} < 0.9::double then 'dev' else 'test' end as split from documents")
def q01_split_hash(spark, d):
    return _docs(spark, d).select("doc_id", H.unit_hash("alpha").alias("u"), H.hash_split("alpha").alias("split"))


@query(f"select split, count(*) as n from (select case when {_UNIT} < 0.8::double then 'train' when {_UNIT} < 0.9::double then 'dev' else 'test' end as split from documents) group by split")
def q02_split_counts(spark, d):
    return _docs(spark, d).groupBy(H.hash_split("alpha").alias("split")).agg(F.count("*").alias("n"))


@query("select doc_id, lang, sha256(text) as alpha from documents qualify row_number() over (partition by text order by doc_id) = 1")
def q03_dedupe_first(spark, d):
    return dedupe.keep_first(_docs(spark, d).select("doc_id", "lang", "alpha"), ["alpha"], ["doc_id"])


@query("select doc_id, lang from documents order by sha256('s:' || sha256(text) || ':' || doc_id), doc_id limit 100")
def q04_stable_limit(spark, d):
    return sample.stable_limit(_docs(spark, d), 100, "s", "alpha", "doc_id").select("doc_id", "lang")


_TURNS = """select doc_id, lang, row_number() over (partition by lang order by sha256('s:' || lang || ':' || sha256(text) || ':' || doc_id), doc_id) - 1 as rn
  from documents where lang <> ''"""


@query(f"select doc_id, lang from ({_TURNS}) order by rn, lang limit 90")
def q05_round_robin(spark, d):
    return sample.round_robin(_docs(spark, d), 90, "s", "alpha", "doc_id", "lang").select("doc_id", "lang")


@query(f"select doc_id, lang from (select *, case lang when 'en' then 3 when 'fr' then 2 else 1 end as w from ({_TURNS})) order by rn // w, lang, rn limit 90")
def q06_weighted_round_robin(spark, d):
    return sample.weighted_round_robin(_docs(spark, d), 90, "s", {"EN": 3, "fr": 2}, "alpha", "doc_id", "lang").select("doc_id", "lang")


_SIZES = "select lang, count(*) as n from documents group by lang"


def _quota_sql(total: str, sizes: str) -> str:
    """Largest remainder over a table (lang, n): floor shares, then one more by remainder."""
    return f"""select lang, n, base + case when row_number() over (order by rem desc, lang) <= {total} - sum(base) over () then 1 else 0 end as quota
      from (select lang, n, floor(share)::bigint as base, share - floor(share) as rem
        from (select lang, n, {total}::double * n / sum(n) over () as share from ({sizes})))"""


_RANKED = "select doc_id, lang, row_number() over (partition by lang order by sha256(sha256(text)), doc_id) as rn from documents"
_DEV = "(select count(*) // 10 from documents)"


@query(f"""with dev as ({_quota_sql(_DEV, _SIZES)}), test as ({_quota_sql(_DEV, "select lang, n - quota as n from dev")})
  select r.doc_id, r.lang, case when r.rn <= dev.quota then 'dev' when r.rn <= dev.quota + test.quota then 'test' else 'train' end as split
  from ({_RANKED}) r join dev using (lang) join test using (lang)""")
def q07_exact_splits(spark, d):
    docs = _docs(spark, d)
    n = docs.count()
    counts = {"dev": n // 10, "test": n // 10, "train": n - 2 * (n // 10)}
    return split.exact_splits(docs, counts, "lang", "alpha", "doc_id").select("doc_id", "lang", "split")


@query(f"select lang, quota from ({_quota_sql('1000', _SIZES)})")
def q08_largest_remainder(spark, d):
    sizes = _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return split.largest_remainder(sizes, 1000, "lang", "n")


@query("""with f as (select doc_id, source, text, row_number() over (partition by source, text order by doc_id) = 1 as first from documents),
  b as (select *, coalesce(sum(first::int) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from f)
  select doc_id, source, case when before >= 30 then 'quota_reached' when not first then 'duplicate' end as reason from b""")
def q09_admission(spark, d):
    docs = _docs(spark, d).withColumn("alpha", F.sha2(F.concat("source", F.lit(":"), "text"), 256)).select("doc_id", "source", "alpha")
    sources = [r[0] for r in docs.select("source").distinct().collect()]
    return A.admit(docs, dict.fromkeys(sources, 30), "alpha", "source", ["doc_id"]).select("doc_id", "source", "reason")


_RATES = ", ".join(f"coalesce(avg(coalesce({m}::double, 0)), 0) as {m}" for m in ("exact_match", "assemblable", "functional"))
_STATEMENTS = "len(list_filter(string_split(rtrim(text, chr(10)), chr(10)), lambda x: trim(x) <> '' and not starts_with(x, '+')))"
_BUCKET = f"case when {_STATEMENTS} <= 3 then '1_3' when {_STATEMENTS} <= 8 then '4_8' when {_STATEMENTS} <= 20 then '9_20' else '21_plus' end"


@query(f"""with {_SCORED}, b as (select *, {_BUCKET} as statements from scored)
  select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' when grouping(statements) = 0 then 'statements' else 'overall' end as dim,
    coalesce(lang, source, statements, 'all') as bucket, count(*) as n, {_RATES}
  from b group by grouping sets ((), (lang), (source), (statements))""")
def q10_eval_report(spark, d):
    rows = _scored(spark, d).withColumn("statements", T.count_bucket(T.statement_count("text")))
    return report.bucket_report(rows, ["lang", "source", "statements"], ("exact_match", "assemblable", "functional"))


@query(f"""with {_SCORED}, f as (select *, list_distinct(list_filter([case when contains(text, '|') then 'pipe' end,
    case when regexp_matches(text, '[0-9]') then 'digit' end, case when contains(text, chr(10)) then 'lines' end], lambda x: x is not null)) as tags from scored),
  e as (select *, unnest(case when len(tags) = 0 then ['no_feature_tags'] else tags end) as bucket from f)
  select bucket, count(*) as n, {_RATES} from e group by bucket""")
def q11_feature_buckets(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("text").contains("|"), "pipe"), F.when(F.col("text").rlike("[0-9]"), "digit"), F.when(F.col("text").contains("\n"), "lines")))
    return report.feature_report(_scored(spark, d).withColumn("tags", tags), "tags", ("exact_match", "assemblable", "functional"))


_LINES = "string_split(rtrim(text, chr(10)), chr(10))"


@query(f"""with {_SCORED}, c as (select *, {_LINES} as cards from scored), k as (select *,
    len(list_filter(cards, lambda x: regexp_matches(trim(x), '^\\+\\s+\\d+\\s+\\d+\\s+\\d+\\s+\\d+\\s+\\d+\\s*$') or regexp_matches(trim(x), '(?i)^\\d{{4}}\\+\\s+.+\\s+f{{1,2}}\\s*$'))) as hits from c)
  select failure_type, count(*) as n from (select case when exact_match then 'exact_match'
    when contains(text, '<IT>') or contains(text, 'User:') or contains(text, 'Assistant:') then 'malformed_source_echo_in_output'
    when len(cards) > 0 and hits >= greatest(2, len(cards) // 2) then 'returned_it_source_instead_of_pit'
    when len(cards) < 10 then 'malformed_pit_card' when not assemblable then 'unassemblable_output'
    when functional then 'functional_success_exact_failure' else 'assembles_but_misexecutes' end as failure_type from k) group by failure_type""")
def q12_taxonomy(spark, d):
    rows = _scored(spark, d).withColumn("cards", T.splitlines("text"))
    return report.taxonomy(rows.withColumn("failure_type", X.classify_failure("cards", "exact_match", "assemblable", "functional")))


_TURN_PAIRS = """pairs as (select a.conv_id, a.turn, a.text as ta, b.text as tb, string_split(a.text, ' ') as xa, string_split(b.text, ' ') as xb
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""


def _turn_pairs(spark, d):
    c = _t(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("ta")).join(after, ["conv_id", "turn"])
    return pairs.withColumns({"xa": F.split("ta", " "), "xb": F.split("tb", " ")})


@query(f"""with {_TURN_PAIRS} select conv_id, turn, xa = xb as exact, len(list_filter(range(greatest(len(xa), len(xb))), lambda i: coalesce(xa[i + 1] = xb[i + 1], false)))::double
    / greatest(len(xa), len(xb), 1) as per_card, len(list_filter(range(greatest(len(xa), len(xb))), lambda i: xa[i + 1] is distinct from xb[i + 1])) as diff_count,
    list_filter(range(greatest(len(xa), len(xb))), lambda i: xa[i + 1] is distinct from xb[i + 1])[1] as first_diff from pairs""")
def q13_per_card(spark, d):
    diffs = D.diff_indices("xa", "xb")
    return _turn_pairs(spark, d).select(
        "conv_id", "turn", D.exact("xa", "xb").alias("exact"), D.per_line_exact("xa", "xb").alias("per_card"),
        F.size(diffs).cast("long").alias("diff_count"), F.try_element_at(diffs, F.lit(1)).cast("long").alias("first_diff"),
    )


@query()
def q14_edit_distance(spark, d):
    return _turn_pairs(spark, d).select("conv_id", "turn", edit_distance("ta", "tb").alias("distance"))


@query(f"""with {_TURN_PAIRS} select conv_id, turn, levenshtein(a, b)::double / greatest(length(a), length(b), 1) as distance
  from (select conv_id, turn, regexp_replace(ta, '[^ -~]', '?', 'g') as a, regexp_replace(tb, '[^ -~]', '?', 'g') as b from pairs)""")
def q14b_levenshtein(spark, d):
    # DuckDB counts bytes, so both sides compare texts with other characters masked
    a, b = (F.regexp_replace(c, "[^ -~]", "?") for c in ("ta", "tb"))
    return _turn_pairs(spark, d).select("conv_id", "turn", edit_distance(a, b, "levenshtein").alias("distance"))


_CATEGORY = "case when functional and not exact_match then 'functional_success_exact_failure' when not assemblable then 'malformed_pit' when diff_count < 3 then 'wrong_constant_card' when diff_count < 7 then 'symbolic_tail_or_reservation_drift' else 'assembles_but_misexecutes_small_diff' end"


def _cases(spark, d):
    c = F.col("diff_count")
    category = (
        F.when(F.col("functional") & ~F.col("exact_match"), "functional_success_exact_failure").when(~F.col("assemblable"), "malformed_pit")
        .when(c < 3, "wrong_constant_card").when(c < 7, "symbolic_tail_or_reservation_drift").otherwise("assembles_but_misexecutes_small_diff")
    )
    return _scored(spark, d).withColumn("category", category)


@query(f"with {_SCORED} select category, lang, count(*) as n from (select *, {_CATEGORY} as category from scored) group by grouping sets ((category, lang), (category))")
def q15_band_category(spark, d):
    return report.category_counts(_cases(spark, d), "lang", "category")


@query(f"""with {_SCORED} select o.ord::int as ord, o.category, coalesce(c.n, 0) as n from (select unnest({X.TAIL_CATEGORIES!r}) as category, unnest(range(6)) as ord) o
  left join (select category, count(*) as n from (select *, {_CATEGORY} as category from scored) group by category) c using (category)""")
def q16_zero_filled(spark, d):
    counts = _cases(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return report.zero_filled(counts, X.TAIL_CATEGORIES)


_ORDER = "normalized_edit_distance desc, diff_count desc, 1 - per_card_exact desc, doc_id desc"


def _plan_sql(plan):
    return "case category " + " ".join(f"when '{c}' then {n}" for c, n in plan) + " else 0 end"


@query(f"""with {_SCORED}, c as (select *, {_CATEGORY} as category from scored), r as (select *, row_number() over (partition by category order by {_ORDER}) as rn from c),
  p as (select *, rn <= {_plan_sql(review.TAIL_PLAN)} as planned from r), f as (select * from p order by planned desc, {_ORDER} limit 10)
  select doc_id, category from f""")
def q17_review_top_tail(spark, d):
    order = review.case_order(ident="doc_id")
    return review.representatives(_cases(spark, d), review.TAIL_PLAN, order, 10, key="doc_id").select("doc_id", "category")


_BAND_PLAN = [("symbolic_tail_or_reservation_drift", 4), ("wrong_constant_card", 2), ("malformed_pit", 2), ("functional_success_exact_failure", 1)]


@query(f"""with {_SCORED}, c as (select *, {_CATEGORY} as category from scored),
  one as (select * from c qualify row_number() over (partition by source order by {_ORDER}) <= 1),
  two as (select * from c where doc_id not in (select doc_id from one) qualify row_number() over (partition by category order by {_ORDER}) <= {_plan_sql(_BAND_PLAN)}),
  both_ as (select * from one union all select * from two),
  rest as (select *, row_number() over (order by {_ORDER}) as k from c where doc_id not in (select doc_id from both_))
  select doc_id, category from both_ union all select doc_id, category from rest where k <= greatest(0, 40 - (select count(*) from both_))""")
def q18_review_top_band(spark, d):
    order = review.case_order(ident="doc_id")
    out = review.band_representatives(_cases(spark, d), _BAND_PLAN, order, 1, 40, band="source", key="doc_id")
    return out.select("doc_id", "category")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def q19_resume_anti(spark, d):
    return report.missing(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def q20_existing_semi(spark, d):
    return report.existing(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


@query("select doc_id, quality from labels where toxic = 0 union all select doc_id, quality + 10 from labels where toxic = 1 union all select -doc_id - 1, 7 from labels where toxic = 1")
def q21_merge_upsert(spark, d):
    labels = _t(spark, d, "labels").select("doc_id", "quality", "toxic")
    changed = labels.where("toxic = 1")
    new = changed.select("doc_id", (F.col("quality") + 10).alias("quality")).unionByName(changed.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(7).alias("quality")))
    return dedupe.upsert(labels.select("doc_id", "quality"), new, ["doc_id"])


@query(f"""with {_SCORED}, m as (select lang, count(*) as n, avg(exact_match::int::double) as exact from scored group by lang)
  select m.lang, m.n, m.exact, case when m.lang <> 'en' then m.exact - b.exact end as delta_exact from m cross join (select exact from m where lang = 'en') b""")
def q22_baseline_delta(spark, d):
    modes = _scored(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("exact_match").cast("double")).alias("exact"))
    return report.deltas(modes, "lang", "en", ["exact"])


@query("select e.v as epochs, r.v as rate from (values (1), (3), (5)) e(v), (values (0.0001::double), (0.0002::double)) r(v)")
def q23_grid(spark, d):
    return report.grid(spark, epochs=[1, 3, 5], rate=[1e-4, 2e-4]).select(F.col("epochs").cast("int").alias("epochs"), "rate")


@query("select event_type, count(v) as n, sum(v) as total, avg(v) as mean, median(v) as median from (select event_type, floor(value * 8) as v from events) group by event_type")
def q24_timing_stats(spark, d):
    return report.timing_stats(_t(spark, d, "events").select("event_type", F.floor(F.col("value") * 8).cast("double").alias("v")), "v", ["event_type"])


@query("""select user_id, event_type from (select user_id, event_type, count(*) as n, min(event_id) as first from events group by all)
  qualify row_number() over (partition by user_id order by n desc, first) = 1""")
def q25_dominant(spark, d):
    counts = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return review.best(counts, ["user_id"], "event_type", ["n"], "first")


@query(f"""with {_SCORED}, s as (select source, avg(functional::int::double) as f, avg(exact_match::int::double) as e,
    coalesce(avg(case when lang = 'en' then functional::int::double end), 0) as b, avg(assemblable::int::double) as a, avg(per_card_exact) as p from scored group by source)
  select source, f >= 0.7::double as functional_ok, e >= 0.5::double as exact_ok, b >= 0.4::double as band_ok, f >= 0.7::double and e >= 0.5::double and b >= 0.4::double as passes,
    (case when a < 0.95::double then -1 when f > 0.5::double or (f = 0.5::double and (e > 0.5::double or (e = 0.5::double and p > 0.5::double))) then 1 when f = 0.5::double and e = 0.5::double and p = 0.5::double then 0 else -1 end)::int as against
  from s""")
def q26_gates(spark, d):
    num = lambda c: F.col(c).cast("double")
    runs = _scored(spark, d).groupBy("source").agg(
        F.avg(num("functional")).alias("functional"), F.avg(num("exact_match")).alias("exact_match"), F.avg(F.when(F.col("lang") == "en", num("functional"))).alias("band_functional"),
        F.avg(num("assemblable")).alias("assemblability"), F.avg("per_card_exact").alias("per_card_exact"),
    )
    half = F.struct(F.lit(0.5).alias("functional"), F.lit(0.5).alias("exact"), F.lit(0.5).alias("per_line"))
    judged = review.gates(runs, "functional", "exact_match", "band_functional").withColumn("against", review.compare_scores(review.selection_score(), half))
    return judged.select("source", "functional_ok", "exact_ok", "band_ok", "passes", "against")


@query("""select 'sys' || chr(10) || chr(10) || 'User:' || chr(10) || '<IT>' || chr(10) || rtrim(a.text, ' ' || chr(10) || chr(9)) || chr(10) || '</IT>' || chr(10) || chr(10) || 'Assistant:' || chr(10) as prompt,
    '<PIT>' || chr(10) || trim(b.text, chr(10)) || chr(10) || '</PIT>' as completion, a.conv_id as id, a.role as band, r.i::int as repeat_index
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
  cross join lateral (select unnest(range(case a.role when 'user' then 3 else 1 end)) as i) r""")
def q27_sft_rows(spark, d):
    c = _t(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return sft.sft_rows(c.join(after, ["conv_id", "turn"]), T.prompt("text", "sys"), T.wrap_completion("reply"), {"user": 3}, "conv_id", "role")


@query("""select doc_id, first_seen::int as first_seen, avg(first_seen::double) over (order by doc_id rows between 999 preceding and current row) as novelty
  from (select doc_id, (row_number() over (partition by text order by doc_id) = 1)::int as first_seen from documents)""")
def q28_novelty(spark, d):
    return A.novelty(_docs(spark, d).select("doc_id", "alpha"), "alpha", ["doc_id"]).select("doc_id", "first_seen", "novelty")


@query(f"""select doc_id, case when len(c) >= 5 then sha256(array_to_string(c[:-6], chr(10))) end as body, case when len(c) >= 5 then sha256(array_to_string(c[-5:], chr(10))) end as tail
  from (select doc_id, {_LINES} as c from documents)""")
def q29_tail_split(spark, d):
    parts = D.split_tail(T.splitlines("text"), 5)
    cut = _t(spark, d, "documents").select("doc_id", parts.alias("p"))
    return cut.select("doc_id", F.sha2(F.array_join("p.body", "\n"), 256).alias("body"), F.sha2(F.array_join("p.tail", "\n"), 256).alias("tail"))


@query(f"""select doc_id, sha256(array_to_string(list_filter(k, lambda x, i: i >= coalesce(list_position(solid, true), 1) and i <= len(k) - coalesce(list_position(list_reverse(solid), true), 1) + 1 and list_contains(solid, true)), chr(10))) as canonical
  from (select doc_id, k, list_transform(k, lambda x: trim(x) <> '') as solid from (select doc_id, list_transform({_LINES}, lambda x: regexp_replace(rtrim(x), ' {{2,}}', ' ', 'g')) as k from documents))""")
def q30_canonicalise(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.array_join(D.canonical(T.splitlines("text"), True, True), "\n"), 256).alias("canonical"))


_SHAPE_LINE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(x, '[ \t]+', ' ', 'g')), '^\d{1,4}\+?( |$)', 'stmt+\1'), '\b[iyc]\d+\b', 'var', 'g'), '\b\d+j\b', 'float', 'g'), '\b\d+\b', 'int', 'g')"""


@query(f"select event_id, sha256(case when starts_with(x, '+') then '+ header' else {_SHAPE_LINE} end || chr(10)) as shape_hash from (select event_id, (event_id % 10000) || '+ y' || user_id || ' z ' || props as x from events)")
def q31_shape_hash(spark, d):
    line = F.concat((F.col("event_id") % 10000).cast("string"), F.lit("+ y"), F.col("user_id").cast("string"), F.lit(" z "), F.col("props"))
    return _t(spark, d, "events").select("event_id", F.sha2(T.shape_normalise(line), 256).alias("shape_hash"))


_ALPHA_RANK = "len(list_distinct(list_filter(list_slice({all}, 1, list_position({all}, {x})), lambda v: left(v, 1) = left({x}, 1))))"


# numbers and variables are told apart by their first character: a rank counts the distinct earlier names with the same first character
@query(f"""
  with e as (select event_id, '+ ' || user_id || ' i1' as head, cast(event_id % 9000 + 1 as varchar) as n1, cast((event_id + user_id) % 9000 + 1 as varchar) as n2,
      'y' || (user_id % 5) as a, 'c' || (event_id % 4) as b, substr('iyc', cast(event_id % 3 as int) + 1, 1) || (user_id % 3) as c, 'i' || (event_id % 5) as k from events),
    f as (select event_id, head, n1, n2, a, b, c, k, [n1] || (case when n2 = n1 then [] else [n2] end) as numbers, [a, b, c, a, k, b, c] as names from e),
    g as (select event_id, head, k, numbers,
      list_transform([a, b, c, k], lambda x: left(x, 1) || {_ALPHA_RANK.format(all="names", x="x")}) as t,
      list_transform([n1, n2], lambda x: lpad(cast(list_position(numbers, x) as varchar), 4, '0') || '+') as m from f)
  select event_id, head || chr(10) || m[1] || ' ' || t[1] || ' z ' || t[2] || ' s ' || t[3] || ' f' || chr(10) || m[2] || ' g 9 ' || t[1] || ' ' || k || 'k ' || t[4] || chr(10)
    || m[1] || ' c' || k || ' ' || t[2] || ' ' || t[3] || ' ff' || chr(10) as alpha from g""")
def q32_alpha_rename(spark, d):
    return _t(spark, d, "events").select("event_id", T.alpha_normalise(source_of_event()).alias("alpha"))


def source_of_event() -> Column:
    """A program text made of an event's ids."""
    number, name = lambda c: (c % 9000 + 1).cast("string"), lambda k, c: F.concat(k if isinstance(k, Column) else F.lit(k), c.cast("string"))
    i, u = F.col("event_id"), F.col("user_id")
    a, b, c, k = name("y", u % 5), name("c", i % 4), name(F.substring(F.lit("iyc"), (i % 3).cast("int") + 1, F.lit(1)), u % 3), name("i", i % 5)
    return F.concat(
        F.lit("+ "), u.cast("string"), F.lit(" i1\n  "), number(i), F.lit("+ "), a, F.lit(" z  "), b, F.lit(" s "), c, F.lit(" f\n"),
        number(i + u), F.lit(" g 9 "), a, F.lit("\t"), k, F.lit("k "), k, F.lit("\r\n"), number(i), F.lit("+ c"), k, F.lit(" "), b, F.lit(" "), c, F.lit(" ff"),
    )


# other characters than ASCII are masked, as DuckDB counts edits of bytes
@query(r"""with q as (select item_id as query_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') as q from benchmark),
    l as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10))) as e, text from documents),
    x as (select regexp_replace(e, '[^\x00-\x7F]', '?', 'g') as e, min(doc_id) as example_id from l where e <> '' group by 1),
    same as (select query_id, min(example_id) as example_id, 1.0::double as score from q join x on q.q = x.e group by 1),
    s as (select query_id, example_id, 1 - levenshtein(q, e)::double / greatest(length(q), length(e), 1) as score from q, x where query_id not in (select query_id from same)),
    t as (select query_id, arg_max({'example_id': example_id, 'score': score}, {'score': score, 'example_id': example_id}) as t from s group by 1)
  select * from same union all select query_id, t.example_id, t.score from t""")
def q33_nearest(spark, d):
    ascii_only = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", "?")
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ascii_only("text").alias("text"))
    lines = _t(spark, d, "documents").select("doc_id", F.explode(T.splitlines("text")).alias("text")).where("text <> ''")
    examples = lines.withColumn("text", ascii_only("text")).groupBy("text").agg(F.min("doc_id").alias("example_id"))
    return retrieve.nearest(items, examples, mode="levenshtein", grams=8)


@query("""select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)
  union select doc_id, lang from documents where doc_id % 2 = 0""")
def q34_subset_union(spark, d):
    docs, labels = _t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels")
    good = report.existing(docs, labels.where("quality = 1"), "doc_id")
    good = report.missing(good, labels.where("toxic = 1"), "doc_id")
    return dedupe.union_first([good, docs.where("doc_id % 2 = 0")], ["doc_id"])


@query("select event_type, user_id % 100 as u, count(distinct user_id) as n from events group by all")
def q35_stream_dedupe(spark, d):
    stream = incremental.read_folder(spark, f"{d}/events.parquet*", _t(spark, d, "events").schema).select("event_type", "user_id")
    folder = shared_folder(spark)
    incremental.run_available(incremental.dedupe(stream, ["event_type", "user_id"]), f"{folder}/out", f"{folder}/checkpoint")
    seen = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return seen.groupBy("event_type", (F.col("user_id") % 100).alias("u")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n from events group by event_type")
def q36_stream_progress(spark, d):
    stream = incremental.read_folder(spark, f"{d}/events.parquet*", _t(spark, d, "events").schema)
    folder = shared_folder(spark)
    return incremental.run_whole(incremental.progress(stream, "event_type"), f"{folder}/out", f"{folder}/checkpoint")


@query("""select source, count(*) as n_files, sha256(string_agg(lpad(doc_id::varchar, 12, '0') || chr(0) || sha256(text) || chr(0), '' order by lpad(doc_id::varchar, 12, '0'))) as digest
  from documents group by source""")
def q37_fileset_digest(spark, d):
    files = _t(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 256).alias("content"))
    return H.fileset_digest(files, ["source"])


@query("""select o.o_orderkey, coalesce(nullif(o.o_orderpriority, '5-LOW'), c.c_mktsegment) as priority, coalesce(n1.n_name, n2.n_name) as nation
  from orders o left join customer c on o.o_custkey = c.c_custkey
  left join nation n1 on o.o_orderkey % 50 = n1.n_nationkey left join nation n2 on c.c_nationkey = n2.n_nationkey""")
def q38_job_enrich(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"))
    customers = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("priority"), F.col("c_nationkey").alias("home"))
    jobs = monitor.fill_from(orders, customers.select("key", "priority"), "key", ["priority"])
    jobs = jobs.join(customers.select("key", "home"), "key", "left").withColumn("asked", (F.col("o_orderkey") % 50).cast("int"))
    nations = _t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return monitor.prioritised(jobs, nations, ("asked", "n_nationkey"), ("home", "n_nationkey"), ["nation"]).select("o_orderkey", "priority", "nation")


@query("select source, count(*) as accepted, max(doc_id) + 1 as next_seed from documents group by source")
def q39_resume_state(spark, d):
    return A.resume_state(_t(spark, d, "documents"), "source", "doc_id")


@query("select count(*) as n, count(*) filter (n_chars > 4000) as n_over, max(n_chars) as longest from documents")
def q40_budget_report(spark, d):
    return report.budget_report(_t(spark, d, "documents"), "doc_id", "n_chars", 4000, ["doc_id"])


@query("select d.doc_id, d.lang, l.quality from documents d left join labels l using (doc_id)")
def q41_reevaluate_left(spark, d):
    return report.reevaluated(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("""select lang, max(case when quality = 1 then n end) - max(case when quality = 0 then n end) as delta_n
  from (select lang, quality, count(*) as n from documents join labels using (doc_id) group by all) group by lang""")
def q42_pair_delta(spark, d):
    n = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").groupBy("lang", (F.col("quality") == 1).alias("on")).agg(F.count("*").alias("n"))
    return report.pair_deltas(n, "lang", "on", ["n"])


@query("select doc_id, printf('%04d_%s', row_number() over (order by n_chars desc, doc_id), doc_id::varchar) as name from documents order by n_chars desc, doc_id limit 50")
def q43_numbered_top(spark, d):
    top = _t(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return review.numbered_names(top, [F.desc("n_chars"), F.col("doc_id")], "doc_id").select("doc_id", "name")


@query("select event_type, n, 2000::int as expected, n / 2000.0::double as share from (select event_type, count(*) as n from events group by event_type)")
def q44_progress(spark, d):
    events = _t(spark, d, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]
    return monitor.progress(events, "event_type", dict.fromkeys(kinds, 2000))


@query()
def q45_corpus(spark, d):
    """Programs for as many seeds a band as there are regions, hashed, admitted and split by hash."""
    quotas = {f"B{k}": 3 for k in range(6)}
    made = corpus.candidates(spark, quotas, _t(spark, d, "region").count()).withColumn("id", F.concat("band", F.lit("-"), "seed"))
    accepted, _ = corpus.build(made, quotas)
    return corpus.split_corpus(accepted).select("id", "band", "seed", "alpha_hash", "shape_hash", "split", "ordinal")


@query(f"""with p as (select c.conv_id, c.turn, string_split(c.text, ' ') as cand, string_split(r.text, ' ') as ref, c.turn % 3 <> 0 as assembles, c.turn % 2 = 0 as runs
    from conversations c left join conversations r on r.conv_id = c.conv_id and r.turn = c.turn - c.turn % 2),
  k as (select *, cand = ref as exact, contains(array_to_string(cand, chr(10)), '<IT>') or contains(array_to_string(cand, chr(10)), 'User:') or contains(array_to_string(cand, chr(10)), 'Assistant:') as echo,
    len(list_filter(cand, lambda x: regexp_matches(trim(x), '^\\+\\s+\\d+\\s+\\d+\\s+\\d+\\s+\\d+\\s+\\d+\\s*$') or regexp_matches(trim(x), '(?i)^\\d{{4}}\\+\\s+.+\\s+f{{1,2}}\\s*$'))) >= greatest(2, len(cand) // 2) as looks from p),
  a as (select *, assembles and (exact or (not echo and not looks and len(cand) >= 10)) as asm from k), f as (select *, asm and runs as fun from a)
  select conv_id, turn, exact as exact_match, asm as assemblable, fun as functional,
    case when exact and (not asm or not fun) then 'evaluator_invariant_failure' when exact then 'exact_match' when echo then 'malformed_source_echo_in_output' when looks then 'returned_it_source_instead_of_pit'
      when len(cand) < 10 then 'malformed_pit_card' when not asm and not assembles then 'wrong_reservation_handling_or_symbolic_output' when not asm then 'unassemblable_output'
      when fun then 'functional_success_exact_failure' else 'assembles_but_misexecutes' end as failure_type from f""")
def q46_reevaluate(spark, d):
    """Turns as decks of words: even turns are references of themselves and of the odd turn after them."""
    c = _t(spark, d, "conversations").withColumn("cards", F.split("text", " "))
    out = F.array(F.lit("out"))
    preds = c.select(
        F.struct("conv_id", F.col("turn") - F.col("turn") % 2).cast("string").alias("id"), "conv_id", "turn", F.col("cards").alias("candidate_cards"),
        F.when(F.col("turn") % 3 != 0, "ok").otherwise("assemble_error").alias("assemble_status"), F.lit("ok").alias("run_status"),
        F.when(F.col("turn") % 2 == 0, out).otherwise(F.array(F.lit("other"))).alias("output_cards"),
    )
    refs = c.select(F.struct("conv_id", "turn").cast("string").alias("id"), F.col("cards").alias("reference_cards"), out.alias("reference_output"))
    return evaluate.reevaluate(preds, refs).select("conv_id", "turn", "exact_match", "assemblable", "functional", "failure_type")


# -- categories by line, archives, phases, command lines, tokens ---------------------------------------------------------

_DECKS = f"""decks as (select doc_id, {_LINES} as ref, toxic = 1 as functional, quality = 1 as exact, quality + toxic > 0 as assemblable,
    list_transform({_LINES}, lambda x, i: case when (doc_id + i) % 29 = 0 then 'tra' || x when (doc_id + i) % 7 = 0 then 'a ' || x else x end)[1:greatest(len({_LINES}) - doc_id % 3, 0)] as all_,
    doc_id % 10 = 0 as missing from documents join labels using (doc_id)), cards as (select * exclude (all_), case when not missing then all_ end as cand from decks)"""


def _decks(spark, d):
    """Lines of labelled documents as reference decks, and changed lines, some missing, as candidates."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").withColumn("ref", T.splitlines("text"))
    at = lambda i, n: (F.col("doc_id") + i + 1) % n == 0
    changed = F.transform("ref", lambda x, i: F.when(at(i, 29), F.concat(F.lit("tra"), x)).when(at(i, 7), F.concat(F.lit("a "), x)).otherwise(x))
    cut = F.slice(changed, 1, F.greatest(F.size("ref") - (F.col("doc_id") % 3).cast("int"), F.lit(0)))
    cand = F.when(F.col("doc_id") % 10 != 0, cut)
    return docs.select("doc_id", "ref", cand.alias("cand"), (F.col("toxic") == 1).alias("functional"), (F.col("quality") == 1).alias("exact"), (F.col("quality") + F.col("toxic") > 0).alias("assemblable"))


_DIFFS = "list_filter(range(greatest(len(ref), len(cand))), lambda i: ref[i + 1] is distinct from cand[i + 1])"
_LABEL = "regexp_extract(lower(trim({x})), '^(\\S+)', 1)"
_A_LABEL = f"starts_with(case when {_LABEL.format(x='coalesce(ref[i + 1], chr(32))')} <> '' then {_LABEL.format(x='coalesce(ref[i + 1], chr(32))')} else {_LABEL.format(x='coalesce(cand[i + 1], chr(32))')} end, 'a')"


@query(f"""with {_DECKS}, k as (select *, {_DIFFS} as diffs, greatest(len(ref), len(cand)) as size from cards where not missing)
  select doc_id, case when functional and not exact then 'functional_success_exact_failure' when not assemblable then 'malformed_pit' when len(diffs) = 0 then 'functional_success_exact_failure'
    when len(list_filter(diffs, lambda i: regexp_matches(lower(coalesce(ref[i + 1], '') || chr(10) || coalesce(cand[i + 1], '')), '{'|'.join(X.TRANSFERS)}'))) > 0 then 'wrong_transfer_target'
    when len(diffs) <= 2 and len(list_filter(diffs, lambda i: {_A_LABEL})) = len(diffs) then 'wrong_constant_card'
    when len(list_filter(diffs, lambda i: {_A_LABEL} or i >= size - 10)) > 0 then 'symbolic_tail_or_reservation_drift' else 'assembles_but_misexecutes_small_diff' end as category from k""")
def q47_tail_category(spark, d):
    return _decks(spark, d).where("cand is not null").select("doc_id", X.tail_category("ref", "cand", "functional", "exact", "assemblable").alias("category"))


@query(f"""with {_DECKS}, k as (select *, case when not missing then list_filter({_DIFFS}, lambda i: not (i = 0 and len(ref) > 0 and len(cand) > 0 and ltrim(ref[1]) = ltrim(cand[1]))) end as diffs,
    greatest(len(ref), len(cand)) as size, trim(coalesce(cand[-1], '')) as last from cards)
  select doc_id, case when missing then 'candidate_missing' when functional and not exact then 'functional_success_exact_failure' when not assemblable then 'malformed_pit'
    when len(diffs) = 0 then 'functional_success_exact_failure' when len(list_filter(diffs, lambda i: i >= size - 12)) < len(diffs) then 'non_tail_divergence'
    when regexp_matches(last, '(?:s00|s0| 00|i)$') or contains(last, ' u0') or last = '3         s' then 'partial_dictionary_tail_truncation'
    when starts_with(last, '4         a') or starts_with(last, '3         a') then 'final_a_dictionary_drop' else 'tail_only_other' end as category from k""")
def q48_band_category(spark, d):
    return _decks(spark, d).select("doc_id", X.band_category("ref", "cand", "functional", "exact", "assemblable").alias("category"))


@query("select user_id, arg_min(v, (ts, event_id)) as v from (select *, case when event_id % 3 > 0 then event_type || event_id % 5 else '' end as v from events) where v <> '' group by user_id")
def q49_first_value(spark, d):
    value = F.when(F.col("event_id") % 3 > 0, F.concat("event_type", (F.col("event_id") % 5).cast("string"))).otherwise("")
    return report.first_value(_t(spark, d, "events").withColumn("v", value), "v", ["ts", "event_id"], ["user_id"])


@query("""with c as (select event_id, value, (row_number() over (order by ts, event_id) - 1) // 64 as chunk from events)
  select event_id, chunk::bigint as chunk, value / count(*) over (partition by chunk) as each from c""")
def q50_chunks(spark, d):
    rows = report.chunked(_t(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 64)
    return report.amortised(rows, "chunk", "value", "each").select("event_id", F.col("chunk").cast("bigint").alias("chunk"), "each")


@query("""select event_id, case when event_id % 11 = 0 or event_id % 13 = 0 then 'failed' when event_id % 4 > 0 and user_id % 6 = 0 then 'remote_generate' when event_id % 17 = 0 then 'remote_train'
    when user_id % 5 = 0 then 'remote_bootstrap' when user_id % 7 = 0 then 'remote_train' when event_id % 2 = 0 then 'training' else 'remote_complete' end as phase,
    case when event_id % 3 = 0 then 'failed' when event_id % 3 = 1 then 'local_reevaluate' when user_id % 2 = 0 and user_id % 4 = 3 then 'complete'
      when user_id % 2 = 0 or user_id % 4 > 0 then 'local_reevaluate' else 'pending' end as output_phase from events""")
def q51_phases(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    state = F.struct(
        F.when(e % 11 == 0, "lost").alias("error"), F.when(e % 13 == 0, "failed").otherwise("running").alias("status"),
        F.when(u % 6 == 0, F.create_map(F.lit("few_shot"), F.struct((e % 4).alias("lines"), F.lit(3).cast("bigint").alias("expected")))).alias("progress"),
        F.lit(None).cast("string").alias("process"), F.lit(None).cast("string").alias("bootstrap_process"),
        F.when(e % 17 == 0, F.struct(F.lit(0).cast("bigint").alias("current"), F.lit(0).cast("bigint").alias("total"))).alias("training"),
        (u % 5 > 0).alias("repo_exists"), (u % 7 > 0).alias("output_exists"), (e % 2 == 0).alias("active_process"), F.lit(None).cast("string").alias("phase"),
    )
    rows = _t(spark, d, "events").select("event_id", "user_id", state.cast(monitor.REMOTE).alias("r"))
    finalizer = F.when(e % 3 == 0, "failed").when(e % 3 == 1, "running")
    output = monitor.output_phase(finalizer, u % 2 == 0, u % 4, F.lit(3))
    return rows.select("event_id", monitor.remote_phase("r").alias("phase"), output.alias("output_phase"))


@query("""select event_id as pid, event_id % 60 || ':00' as elapsed, event_type || ' ' || user_id as name, case when event_id % 2 = 0 then (event_id % 9)::bigint end as "limit",
    case when event_id % 3 > 0 then event_id::bigint end as example_count, event_id % 5 = 0 as detached from events where event_id % 4 > 0""")
def q52_process_list(spark, d):
    e = F.col("event_id")
    script = F.when(e % 4 > 0, "/opt/jobs/run_job.py").otherwise("/opt/jobs/other.py")
    line = F.concat_ws(
        " ", F.concat(F.lit("  "), e.cast("string")), F.concat((e % 60).cast("string"), F.lit(":00")), F.lit("python"), script, F.concat(F.lit("--name '"), "event_type", F.lit(" "), "user_id", F.lit("'")),
        F.when(e % 2 == 0, F.concat(F.lit("--limit "), (e % 9).cast("string"))), F.when(e % 3 > 0, F.concat(F.lit("--max-examples "), e.cast("string"))), F.when(e % 5 == 0, F.lit("--detach-remote")),
    )
    return monitor.process_table(_t(spark, d, "events").select(line.alias("value")), "run_job.py").select("pid", "elapsed", "name", "limit", "example_count", "detached")


@query(f"""with {_TURN_PAIRS}, p as (select conv_id, turn, list_transform(xa, lambda x: length(x)) as a, list_transform(xb, lambda x: length(x)) as b from pairs),
  t as (select conv_id, turn, list_concat(a, b)[1:40] as ids, list_concat(list_transform(a, lambda x: -100), b)[1:40] as labels from p)
  select conv_id, turn, list_sum(ids)::bigint as ids, list_sum(labels)::bigint as labels, len(ids)::int as n from t where len(list_filter(labels, lambda x: x <> -100)) > 0""")
def q53_token_labels(spark, d):
    lengths = lambda c: F.transform(c, F.length)
    rows = _turn_pairs(spark, d).withColumn("t", T.token_labels(lengths("xa"), lengths("xb"), 40)).where(T.trainable("t.labels"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return rows.select("conv_id", "turn", total("t.input_ids").alias("ids"), total("t.labels").alias("labels"), F.size("t.input_ids").alias("n"))


@query("select event_id, case when event_id % 3 > 0 then (event_id % 9999)::int end as location from events")
def q54_symbolic_location(spark, d):
    e = F.col("event_id")
    card = F.format_string("x %04d 6%s %04d %04d  ", e % 9999, F.when(e % 3 > 0, "0").otherwise("0x"), e % 77, e % 99)
    return _t(spark, d, "events").select("event_id", T.symbolic_location(card).alias("location"))


@query(f"""with {_SCORED}, f as (select doc_id, case when exact_match then 'exact_match' when n_chars % 5 > 0 then 'kind' || n_chars % 3 end as failure_type from scored),
    r as (select * from f where failure_type is not null and failure_type <> 'exact_match' order by doc_id limit 25)
  select failure_type, count(*) as n, any_value(null) as name from r group by rollup (failure_type)
  union all select failure_type, 1, lpad(row_number() over (order by doc_id)::varchar, 4, '0') || '_' || doc_id from r""")
def q55_failure_archive(spark, d):
    scored = _scored(spark, d)
    kind = F.when(F.col("exact_match"), "exact_match").when(F.col("n_chars") % 5 > 0, F.concat(F.lit("kind"), (F.col("n_chars") % 3).cast("string")))
    predictions = scored.select(F.col("doc_id").alias("id"), kind.alias("failure_type"))
    cases = reviews.failure_cases(predictions, scored.select(F.col("doc_id").alias("id"), "lang"), ["id"], 25)
    manifest = reviews.failure_manifest(cases).withColumn("name", F.lit(None).cast("string"))
    return manifest.unionByName(cases.select("failure_type", F.lit(1).cast("bigint").alias("n"), "name"))


# -- sources, prompts, trees and paths -----------------------------------------------------------------------------------


@query("""select event_id, case when event_id % 7 = 0 then 'header' when event_id % 11 = 0 then 'statement' when event_id % 13 = 0 then 'unterminated' end as error,
    case when event_id % 7 > 0 and event_id % 11 > 0 and event_id % 13 > 0 then '+ ' || event_id || ' 2 0 ' || user_id || ' 9' || chr(10) || lpad((event_id % 999)::varchar, 4, '0') || '+ y1 z c' || user_id || ' f' || chr(10)
      || '0' || lpad((user_id % 90 + 100)::varchar, 3, '0') || '+ t y1 ff' || chr(10) end as source from events""")
def q56_normalise_source(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    text = F.concat(
        F.when(e % 7 == 0, "+ 1 2 3").otherwise(F.concat(F.lit("+   "), e.cast("string"), F.lit(" 02 000\t"), u.cast("string"), F.lit("  9 "))), F.lit("\n\n"),
        (e % 999).cast("string"), F.lit("   Y1  Z c"), u.cast("string"), F.lit("  F \r\n"), F.when(e % 11 == 0, "no statement\n").otherwise(""),
        (u % 90 + 100).cast("string"), F.lit("+ T\ty1 "), F.when(e % 13 == 0, "f").otherwise("FF"), F.lit("\nleft over"),
    )
    # what is left over counts only where nothing ended the program
    text = F.when(e % 13 == 0, F.regexp_replace(text, "\nleft over$", "")).otherwise(text)
    rows = _t(spark, d, "events").select("event_id", T.normalise_source(text).alias("out"))
    return rows.select("event_id", F.col("out.error").alias("error"), F.col("out.text").alias("source"))


@query("""select event_id, sha256(event_type || chr(10) || user_id || chr(10) || sha256(props) || chr(10) || sha256(event_type) || chr(10) || coalesce(case when event_id % 3 > 0 then 'p' end, null)) as id from events""")
def q57_record_id(spark, d):
    deck = F.when(F.col("event_id") % 3 > 0, "p")
    return _t(spark, d, "events").select("event_id", H.record_id("event_type", "user_id", H.sha256("props"), H.sha256("event_type"), deck).alias("id"))


@query("""select event_id, case when event_id % 4 = 3 then event_type || ' ' || user_id else '  ' || event_type || chr(10) || user_id end as deck,
    case when event_id % 4 = 0 then 'because ' || user_id else '' end as trace, case when event_id % 2 = 0 then props end as source from events""")
def q58_completions(spark, d):
    e = F.col("event_id")
    body = F.concat(F.lit("  "), "event_type", F.lit("\n"), F.col("user_id").cast("string"))
    said = (
        F.when(e % 4 == 0, F.concat(F.lit("because "), F.col("user_id").cast("string"), F.lit(" <PIT>\n"), body, F.lit("\n</PIT> done")))
        .when(e % 4 == 1, F.concat(F.lit("<PIT>\n"), body, F.lit("\n</PIT>"))).when(e % 4 == 2, F.concat(F.lit("<PIT>\n"), body))
        .otherwise(F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit("</PIT> more")))
    )
    asked = F.when(e % 2 == 0, T.prompt(F.concat("props", F.lit("\n")), "system")).otherwise("no source here")
    return _t(spark, d, "events").select("event_id", T.completion_deck(said).alias("deck"), T.thinking_trace(said).alias("trace"), T.source_of_prompt(asked).alias("source"))


@query("""select event_id, case when event_id % 5 < 4 then (event_id % 5)::int end as depth, event_id % 5 in (2, 3) and event_id % 2 = 0 as indexed, event_id % 5 < 4 and event_id % 3 = 0 as loop,
    case event_id % 5 when 0 then '1' when 1 then '1' when 2 then '2' when 3 then '3' else 'unknown' end as bucket from events""")
def q59_tree_facts(spark, d):
    e = F.col("event_id")
    subscript = F.when(e % 2 == 0, '{"lhs":{"value":1},"rhs":{"value":2}}').otherwise('{"value":1}')
    leaf = F.concat(F.lit('{"cls":"c","index":'), F.when(e % 5 >= 2, subscript).otherwise('{"value":3}'), F.lit("}"))
    # a subscript with two sides is one level itself
    less = F.when((e % 2 == 0) & (e % 5 >= 2), 1).otherwise(0)
    tree = leaf
    for k in (1, 2, 3):
        tree = F.when(e % 5 - less >= k, F.concat(F.lit('{"lhs":{"value":1},"rhs":'), tree, F.lit("}"))).otherwise(tree)
    loop = F.when(e % 3 == 0, ',{"end_stmt":3,"loop_var":{"value":1}}').otherwise("")
    # an expression counts one level only where it is a member, so statements hold their sides themselves
    text = F.concat(F.lit('{"statements":['), tree, loop, F.lit("]}"))
    out = tree_columns(F.when(e % 5 == 4, "{broken").otherwise(text))
    rows = _t(spark, d, "events").select("event_id", out.alias("t"))
    return rows.select("event_id", "t.depth", "t.indexed", "t.loop", depth_bucket("t.depth").alias("bucket"))


@query("""select event_id, case when event_id % 2 = 0 then '/data/' || event_type else '/base/x/' || event_type end as path, case when event_id % 3 = 0 then '/new/' || user_id else '/other/' || user_id end as moved,
    (case when event_id % 5 = 0 then -1 else 1 end) * user_id as accumulator, case when event_id % 4 > 0 then event_id % 50 end as done, case when event_id % 4 > 0 then 50 end as total from events""")
def q60_paths_and_logs(spark, d):
    e = F.col("event_id")
    path = F.concat(F.when(e % 2 == 0, "/data/").otherwise("x/"), "event_type")
    moved = F.concat(F.when(e % 3 == 0, "/old/").otherwise("/other/"), F.col("user_id").cast("string"))
    log = F.when(e % 4 > 0, F.concat(F.lit("start 1/50\n"), (e % 50).cast("string"), F.lit("/50 steps\nwaiting"))).otherwise("nothing yet")
    signed = F.concat(F.col("user_id").cast("string"), F.when(e % 5 == 0, "-").otherwise("+"))
    rows = _t(spark, d, "events").select("event_id", records.resolve_path(path, "/base/").alias("path"), F.struct(moved.alias("to")).alias("m"), T.signed_accumulator(signed).alias("accumulator"), T.last_progress(log).alias("p"))
    return records.rewrite_prefix(rows, ["m.to"], "/old", "/new").select("event_id", "path", F.col("m.to").alias("moved"), "accumulator", "p.done", "p.total")


@query("select doc_id, n_chars from documents where n_chars > 3000")
def q61_over_budget(spark, d):
    return report.over_budget(_t(spark, d, "documents"), "doc_id", "n_chars", 3000)


@query("""with s as (select doc_id, source, lang, n_chars from documents), k as (select distinct source from s where lang = 'en'),
    j as (select doc_id, source, case when n_chars % 2 = 0 then 'complete' when n_chars % 3 = 0 then 'running' end as status from s)
  select doc_id, status from j where source not in (select source from k) and coalesce(status <> 'complete', true)""")
def q62_detached(spark, d):
    docs = _t(spark, d, "documents")
    status = F.when(F.col("n_chars") % 2 == 0, "complete").when(F.col("n_chars") % 3 == 0, "running")
    jobs = docs.select("doc_id", "source", status.alias("status"))
    return monitor.detached(jobs, docs.where("lang = 'en'"), "source").select("doc_id", "status")


@query("""with t as (select doc_id, lang, source from documents), p as (select doc_id, lang, source from t where doc_id % 4 > 0),
    a as (select *, row_number() over (partition by lang order by sha256('c:s100_en_e12:train:' || lang || ':' || source || ':' || doc_id), doc_id) - 1 as rn from p),
    w as (select *, rn // (case when upper(lang) = 'EN' then 4 else 1 end) as turn from a)
  select doc_id, lang from w order by turn, lang, rn limit 100""")
def q63_curriculum_step(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source")
    step = curriculum.Step(100, 12, {"EN": 4})
    train, _ = curriculum.step_tables(step, docs.where("doc_id % 4 > 0"), [docs.where("doc_id % 4 = 0")], "c", ident="source", key="doc_id", band="lang")
    return train.select("doc_id", "lang")
