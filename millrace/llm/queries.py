"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import decontaminate, filter_audit, jaccard, licences, lines, neighbours, paragraphs, pieces, ppm, quality, repeats, suffixes, token_counts


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_suffix_array_dedup(spark, sf_dir):
    out = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece_nbest(spark, sf_dir):
    return pieces.encode(_read(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark, sf_dir):
    return neighbours.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_quality_cotraining(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op6_line_dedup(spark, sf_dir):
    docs = lines.dedup_lines(_read(spark, sf_dir, "documents"), details=True, whole_runs=True)
    return docs.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated_pairs(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_paragraph_dedup(spark, sf_dir):
    docs = paragraphs.dedup_paragraphs(_read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_paragraphs", "n_bytes", "n_removed", "n_spans", "removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_ppm_scoring(spark, sf_dir):
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return ppm.score(_read(spark, sf_dir, "documents"), F.crc32(key) % 5 == 1)


def op10_license_scan(spark, sf_dir):
    return licences.license_scan(_read(spark, sf_dir, "documents")).drop("modified")  # the operator has it, the query's columns are fixed by its test


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_word_runs(spark, sf_dir):
    return repeats.word_runs(_read(spark, sf_dir, "documents"), stretch=True)


def queries():
    every = (op1_suffix_array_dedup, op2_sentencepiece_nbest, op3_ngram_jaccard, op4_embedding_near_dedup, op5_quality_cotraining, op6_line_dedup, op7_benchmark_decontamination, op8_paragraph_dedup, op9_ppm_scoring, op10_license_scan,
        op11_token_counts, op12_filter_audit, op13_word_runs)
    return {f.__name__: f for f in every}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _sets(table: str, ident: str) -> str:
    """SQL: the distinct five-word shingles of each text."""
    return f"""select {ident}, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
    from (select {ident}, regexp_extract_all({_LOWER}, '{_WORD}') as w from {table})"""


# windows of 400 bytes as hexadecimal text, counted by their digest; covering spans by gaps and islands
_OP1 = """with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
  w as (select doc_id, p, md5_number(substr(x, 2 * p + 1, 800)) as h from (select doc_id, x, unnest(range(n - 399)) as p from d where n >= 400)),
  r as (select doc_id, p from w qualify count(*) over (partition by h) > 1),
  i as (select doc_id, p, case when p - lag(p) over o <= 400 then 0 else 1 end as head from r window o as (partition by doc_id order by p)),
  g as (select doc_id, p, sum(head) over (partition by doc_id order by p) as k from i),
  s as materialized (select doc_id, k, min(p) as a, max(p) + 400 as b from g group by 1, 2),
  t as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from s group by 1),
  e as (select doc_id, b as a from s union all select doc_id, 0 from d),
  q as (select e.doc_id, e.a, coalesce(min(s.a), any_value(d.n)) as z from e join d using (doc_id) left join s on s.doc_id = e.doc_id and s.a >= e.a group by 1, 2),
  kept as (select q.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' order by a) as y from q join d using (doc_id) group by 1)
  select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(y)) as kept_sha256
  from d join kept using (doc_id) left join t using (doc_id)"""

_OP3 = f"""with recursive sets as materialized ({_sets('documents', 'doc_id')}), n as materialized (select doc_id, coalesce(len(s), 0)::bigint as n from sets),
  x as materialized (select doc_id, unnest(s) as h from sets),
  both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
  links as materialized (select a, b from both_ join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
  edges as materialized (select a, b from links union all select b, a from links),
  reach(doc_id, c) as (select doc_id, doc_id from n union select e.b, r.c from reach r join edges e on e.a = r.doc_id where r.c < e.b)
  select n.doc_id, n.n as n_shingles, min(c) as component_id from n join reach using (doc_id) group by 1, 2"""

_OP4 = """with recursive v as materialized (select vec_id, label, embedding::double[] as e from embeddings),
  links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
  reach(vec_id, c) as (select vec_id, vec_id from v union select l.b, r.c from reach r join links l on l.a = r.vec_id where r.c < l.b),
  c as (select vec_id, min(c) as component_id from reach group by 1), k as (select a as vec_id, count(*) as n from links group by 1)
  select vec_id, coalesce(n, 0)::bigint as n_links, component_id, component_id = vec_id as kept from c left join k using (vec_id)"""

# a line goes if it is in a later copy of one of the shortest runs of 50 words from a line on or up to a line
_OP6 = f"""with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as every from documents),
  l as (select *, case when every[-1] = '' then every[:-2] else every end as x from d),
  c as (select *, list_transform(x, lambda y: len(regexp_extract_all(y, '{_WORD}'))) as k from l),
  s as materialized (select *, list_transform(range(1, len(x) + 1), lambda i: list_sum(k[1:i])) as cum from c),
  pos as (select doc_id, x, cum, unnest(range(1, len(x) + 1)) as i from s where len(x) > 0),
  runs as (select doc_id, x, i as a, len(list_filter(cum, lambda y: y < coalesce(cum[i - 1], 0) + 50)) + 1 as b from pos
    union all select doc_id, x, len(list_filter(list_prepend(0, cum[:-2]), lambda y: y <= cum[i] - 50)) as a, i as b from pos),
  keyed as (select distinct doc_id, a, b, md5(array_to_string(x[a:b], chr(10))) as h from runs where a >= 1 and b <= len(x)),
  later as (select doc_id, a, b from keyed qualify (doc_id, a) > min((doc_id, a)) over (partition by h)),
  gone as materialized (select distinct doc_id, unnest(range(a, b + 1)) as i from later),
  g as (select doc_id, list(i order by i) as gone, count(*) as n from gone group by 1)
  select doc_id, len(x)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed, coalesce(len(list_filter(gone, lambda i: not list_contains(gone, i - 1))), 0)::bigint as n_spans,
    sha256(case when n is null then coalesce(text, '') else array_to_string(list_filter(every, lambda y, i: not list_contains(gone, i)), chr(10)) end) as kept_sha256
  from s left join g using (doc_id)"""

_OP7 = f"""with sets as materialized ({_sets('documents', 'doc_id')}), items as materialized (select * from ({_sets('benchmark', 'item_id')}) where len(s) > 0),
  x as (select doc_id, unnest(s) as h from sets), y as (select item_id, len(s) as n_item, unnest(s) as h from items)
  select doc_id, item_id, n_item::bigint as n_item, count(*)::bigint as n_shared from x join y using (h) group by 1, 2, 3 having 100 * count(*) >= 80 * n_item"""

# every document against every order: no cells, no sets of filters
_OP12 = f"""with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
  w as (select doc_id, part, t, regexp_extract_all(t, '{_WORD}') as w, min(doc_id) over (partition by t) as least from d),
  m as materialized (select doc_id, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > least, false) as e from w),
  l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as bad from labels where doc_id is not null group by 1),
  x as materialized (select part, coalesce(good, false) as good, coalesce(bad, false) as bad,
    case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as fails
    from m left join l using (doc_id)),
  orders(filter_order) as (select '' union all select filter_order || f from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(filter_order, f)),
  s as (select filter_order, unnest(range(1, 6)) as step from orders where len(filter_order) = 5),
  y as (select part, filter_order, step, fails, good, bad, filter_order[step] as f,
    case when fails = '' then 9 else list_min(list_transform(string_split(fails, ''), lambda z: strpos(filter_order, z))) end as gone from x, s),
  z as (select part, filter_order, step, any_value(f) as f, count(*) filter (gone > step) as kept, count(*) filter (gone = step) as removed,
    count(*) filter (gone < step and contains(fails, f)) as redundant, count(*) filter (fails = f) as unique_fails, count(*) filter (gone = step and good) as good_lost,
    count(*) filter (gone = step and bad) as toxic_lost from y group by 1, 2, 3)
  select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from z"""


def oracle_sql():
    """SQL of the operators that it can express: all of them compare whole texts or all pairs of the table.

    Segmentation, classifiers, MinHash, language models and licence rules are
    compared with plain versions in tests/llm instead.
    """
    return {
        "op1_suffix_array_dedup": _OP1, "op3_ngram_jaccard": _OP3, "op4_embedding_near_dedup": _OP4, "op6_line_dedup": _OP6, "op7_benchmark_decontamination": _OP7,
        "op12_filter_audit": _OP12,
    }
