"""The registered queries of this subpackage: whole tables in, digest columns out."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from highwater.llm.ann import nearest
from highwater.llm.common import Scratch
from highwater.llm.decontaminate import contained_items
from highwater.llm.language_id import language_ids
from highwater.llm.ngram_join import shingle_join
from highwater.llm.packing import pack
from highwater.llm.pii import find_personal_data
from highwater.llm.quality import quality_scores
from highwater.llm.resample import resample
from highwater.llm.token_counts import token_counts
from highwater.llm.token_files import read_token_files, write_token_files
from highwater.llm.toxicity import toxicity_scores
from highwater.llm.url_filter import judge_urls
from highwater.llm.vector_codes import vector_codes

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
# hosts that are blocked where no rule fits
BLOCKED_HOSTS = ["ads-track.example.com/", "casino-win.example.net/", "spam-farm.example.org/", "adult-x.example.com/", "cheap-pills.example.net/", "free-bets.example.net/"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(_read(spark, sf_dir, "documents"), k=3, percent=90)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).path}/tokens"
    write_token_files(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), RULES, BLOCKED_HOSTS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(_read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_pii, op3_token_files, op4_decontaminate, op5_url_filter, op6_quality, op7_toxicity, op8_ann, op9_packing,
                                   op10_token_counts, op11_resample, op12_language_id, op13_vector_codes)}

_WORDS = """[x for x in string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> '']"""
_SHINGLES = """case when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"""

_ASSIGN = """a{r} as materialized (select p.rn, p.part, min(list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) for i in range(1, len(p.x) + 1)])::bigint * 64 + e) as de
              from p join b{r} as b using (part) group by p.rn, p.part)"""
_UPDATE = """m{r} as (select part, de % 64 as e, i, sum(x[i])::bigint as s, count(*) as n from a{o} join p using (rn, part), unnest(range(1, len(x) + 1)) as u(i) group by part, de % 64, i),
        n{r} as (select part, e, list((s - ((s % n) + n) % n) // n order by i) as x from m{r} group by part, e),
        b{r} as materialized (select part, e, coalesce(n{r}.x, b{o}.x) as x from b{o} left join n{r} using (part, e))"""

CHECKS: dict[str, str] = {
    "op4_decontaminate": f"""
        with d as (select doc_id, unnest({_SHINGLES}) as s from (select doc_id, {_WORDS.format(t="text")} as w from documents)),
        i as (select item_id, len(g) as n, unnest(g) as s from (select item_id, {_SHINGLES} as g from (select item_id, {_WORDS.format(t="text")} as w from benchmark)))
        select doc_id, item_id, n as n_shingles, count(*) as n_shared, count(*) / n as containment
        from d join i using (s) group by doc_id, item_id, n having 100 * count(*) >= 80 * n""",
    "op5_url_filter": """
        with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h0 from r),
        p as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') as path from h),
        rules(verdict, rule, rh, rp) as (values """ + ", ".join(f"('{v}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES) + """),
        blocked(bh) as (values """ + ", ".join(f"('{b[:-1]}')" for b in BLOCKED_HOSTS) + """),
        best as (select page_id, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict from p join rules
                 on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
        select page_id, host, path, rule, coalesce(best.verdict, case when starts_with(path, '/') and exists (select 1 from blocked where host = bh or ends_with(host, '.' || bh))
               then 'block' else 'allow' end) as verdict from p left join best using (page_id)""",
    "op11_resample": r"""
        with recursive step(i, k, c) as (select range, 0, range from range(256) union all
            select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
        tab as materialized (select list(c order by i) as t from step where k = 8),
        w as (select side, doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w
              from (select 's' as side, doc_id, text from documents union all select 't', null, text from benchmark)),
        f as materialized (select side, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]
                || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as f from w),
        u as materialized (select f, hex(encode(f)) as h, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from f group by f),
        b as materialized (select f, s, u.t, xor(list_reduce([4294967295::bigint] || [(('0x' || h[2 * i - 1:2 * i])::bigint) for i in range(1, len(h) // 2 + 1)],
                lambda c, x: xor(c >> 8, tab.t[1 + xor(c & 255, x)])), 4294967295) % 10000 as b from u, tab),
        g as (select b, floor(1000 * ln(((sum(t) + 1)::double * (select sum(s) + 10000 from b)) / ((sum(s) + 1)::double * (select sum(t) + 10000 from b))))::bigint as g from b group by b),
        d as (select doc_id, count(*) as n, sum(g)::bigint as weight from f join b using (f) join g using (b) where side = 's' group by doc_id),
        scored as (select w.doc_id, len(w) as nw, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
              from w left join d using (doc_id) where side = 's'),
        drawn as (select *, row_number() over (partition by nw >= 20 order by score desc, doc_id) as r, count(*) filter (nw >= 20) over () as big_n from scored)
        select doc_id, n_features, weight, score, case when nw >= 20 and r <= 5 * big_n // 100 then r end as rank, nw as n_words from drawn""",
    "op13_vector_codes": """
        with k as materialized (select row_number() over (order by vec_id) as rn, vec_id, label, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
              where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        p as materialized (select rn, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] as x from k, range(16) as t(part)),
        b0 as materialized (select part, rn - 1 as e, x from p where rn <= 64), """ + ", ".join([
            _ASSIGN.format(r=0), _UPDATE.format(r=1, o=0), _ASSIGN.format(r=1), _UPDATE.format(r=2, o=1), _ASSIGN.format(r=2)]) + """,
        c as (select rn, string_agg(printf('%02x', de % 64), '' order by part) as code, sum(de // 64)::bigint as error from a2 group by rn),
        h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) as codebooks_sha256 from b2)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256, label from k join c using (rn), h""",
}
