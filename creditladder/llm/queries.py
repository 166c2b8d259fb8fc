"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    jaccard_join,
    langid,
    licenses,
    main_text,
    mixing,
    near_vectors,
    packing,
    quality,
    quality_rules,
    secrets,
    source_divergence,
    token_counts,
    word_runs,
)
from .quality_rules import SPACE, let

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN_LIMIT = 512
QUALITY_CUT = 0.3


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.find_secrets(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    spans = F.col("spans")
    counts = [secrets.count(spans, k).alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.listing(spans, secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.listing(spans).alias("spans"),
    )


def fold(folds: int) -> Column:
    """The part of a split that a document belongs to."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(3, 1)))
    return langid.predict(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def held_out(folds: int, part: int) -> Column:
    """Not learned from. Rows without an id are held out."""
    return F.coalesce(fold(folds) == part, F.lit(True))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*columns, F.array_join("rules", ",").alias("rules"))


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in the mix of their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select(
        "doc_id", "source", *[F.col(f"mix_{c}").cast("long").alias(c) for c in ("copy", "block", "release", "deadline", "slot", "position")]
    )


ORACLES["op1_mix_sources"] = f"""
with recursive sizes as (
  select case when source is null then '-' else '+' || source end src, count(*) n from documents group by all),
shared as (
  select *, 1 + pow(n, {mixing.EXPONENT}) / sum(pow(n, {mixing.EXPONENT})) over () * ({mixing.PERIOD} - count(*) over ()) exact from sizes),
ranked as (
  select src, n, cast(floor(exact) as bigint) low, row_number() over (order by floor(exact) - exact, src) k,
         {mixing.PERIOD} - sum(cast(floor(exact) as bigint)) over () spare from shared),
sources as (select src, n, low + case when k <= spare then 1 else 0 end c from ranked),
edf(t, src, c, had, took) as (
  select cast(-1 as bigint), src, cast(c as bigint), cast(0 as bigint), false from sources
  union all
  select t + 1, src, c, had + case when pick then 1 else 0 end, pick from (
    select *, row_number() over (
      order by case when had < c and had * {mixing.PERIOD} // c <= t + 1
                    then (had * {mixing.PERIOD} + {mixing.PERIOD} + c - 1) // c else 1000000000 end, src) = 1 pick
    from edf) e
  where t < {mixing.PERIOD - 1}),
slots as (select src, c, had - 1 r, t from edf where took),
lengths as (
  select max(((n + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} - 1) // s.c * {mixing.PERIOD} + l.t + 1) len
  from sources s join slots l on l.src = s.src and l.r = ((n + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} - 1) % s.c),
planned as (
  select s.src, n, s.c, len // {mixing.PERIOD} * s.c
         + (select count(*) from slots l where l.src = s.src and l.t < len % {mixing.PERIOD}) blocks
  from sources s, lengths),
docs as (
  select doc_id, source, case when source is null then '-' else '+' || source end src,
         row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 i from documents),
copies as (
  select doc_id, source, d.src, c, u.k copy, i + u.k * n q
  from docs d join planned p on d.src = p.src,
       lateral (select unnest(range(0, cast(ceil((blocks * {mixing.BLOCK_ROWS} - i) / n) as bigint))) k) u)
select doc_id, source, copy, q // {mixing.BLOCK_ROWS} block,
       (q // {mixing.BLOCK_ROWS}) * {mixing.PERIOD} // x.c release,
       ((q // {mixing.BLOCK_ROWS} + 1) * {mixing.PERIOD} + x.c - 1) // x.c deadline,
       q // {mixing.BLOCK_ROWS} // x.c * {mixing.PERIOD} + t slot,
       (q // {mixing.BLOCK_ROWS} // x.c * {mixing.PERIOD} + t) * {mixing.BLOCK_ROWS} + q % {mixing.BLOCK_ROWS} position
from copies x join slots l on l.src = x.src and l.r = q // {mixing.BLOCK_ROWS} % x.c
"""


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of all vectors."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op10_near_vectors"] = """
with recursive v as (
  select vec_id, cast(embedding as double[]) e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) n from v where list_inner_product(e, e) > 0),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id
      and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
low as (select a, least(a, min(b)) b from reach group by a),
n as (select a, count(*) k from l group by a)
select vec_id, coalesce(k, 0) n_links, coalesce(low.b, vec_id) component_id, coalesce(low.b, vec_id) = vec_id kept
from embeddings left join n on n.a = vec_id left join low on low.a = vec_id
"""


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of all documents."""
    return jaccard_join.near_documents(table(spark, sf_dir, "documents"))


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = main_text.extract(table(spark, sf_dir, "pages"), main_text.fit())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _op9_sql() -> str:
    q = quality_rules
    shares = {
        "symbols": "case when word_chars > 0 then n_symbols / word_chars else 0e0 end",
        "dup_lines": "case when n_lines > 0 then n_dup_lines / n_lines else 0e0 end",
        "repeats": "case when n_words > 0 then n_repeat_words / n_words else 0e0 end",
        "long_words": "case when n_words > 0 then n_long_words / n_words else 0e0 end",
    }
    stratum = "case " + " ".join(f"when n_words >= {least} then {i}" for i, least in reversed(list(enumerate(q.STRATA)))) + " end"
    level, limit = q.DELTA / (len(q.STRATA) * len(q.RULES) * len(q.GRID)), q.RISK / len(q.RULES)
    space = r"[\x20\x09-\x0D]"
    return rf"""
with d as (
  select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
      from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d) p),
r as (select doc_id, count(distinct i + k) n
      from (select *, count(*) over (partition by doc_id, g) c from g) x, (select unnest([0, 1, 2]) k) o where c > 1 group by doc_id),
s as (
  select d.doc_id, len(w) n_words, length(regexp_replace(t, '{space}', '', 'g')) word_chars,
         length(t) - length(translate(t, '{q.SYMBOLS}', '')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
         coalesce(r.n, 0) n_repeat_words, len(l) n_lines, len(list_filter(w, lambda x: length(x) > 20)) n_long_words
  from d left join r on d.doc_id = r.doc_id),
x as (select *, {stratum} stratum, n_words < {q.LEAST_WORDS} or 100 * n_repeat_words > {q.MOST_REPEATED} * n_words base_failed,
             {", ".join(f"{v} {k}" for k, v in shares.items())} from s),
good as (select * from x where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
long as (select stratum, rule, v from (select stratum, unnest({list(q.RULES)}) rule, unnest([{", ".join(q.RULES)}]) v from good) y),
k as (select stratum, rule, cut, count(*) n, count(*) filter (v > cut) k
      from long, (select unnest([{", ".join(f"{c!r}e0" for c in q.GRID)}]) cut) c group by all),
p as (select stratum, rule, cut, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({limit}) + (n - j) * ln(1 - {limit}))) p
      from (select *, unnest(range(0, k + 1)) j from k) z group by all),
cuts as (select stratum, rule, min(cut) cut from p where p <= {level!r} group by all),
hit as (select doc_id, x.stratum, u.rule, u.v > c.cut over_cut
        from (select doc_id, stratum, unnest({list(q.RULES)}) rule, unnest([{", ".join(q.RULES)}]) v from x) u
        join x using (doc_id) join cuts c on c.stratum = x.stratum and c.rule = u.rule),
broken as (select doc_id, string_agg(rule, ',' order by list_position({list(q.RULES)}, rule)) rules from hit where over_cut group by doc_id)
select x.doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
       cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
       not base_failed and rules is null kept, coalesce(rules, '') rules
from x left join broken on broken.doc_id = x.doc_id
"""


ORACLES["op9_quality_rules"] = _op9_sql()


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])

    def labels(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language, and the terms that each has more of."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
with d as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') t
  from documents),
terms as (select r, lang, source, unnest(t) term from d),
kept as (select lang, term, count(*) n from terms group by all having count(distinct r) >= 30),
langs as (select lang, count(term) v, coalesce(sum(n), 0) total from (select distinct lang from d) x left join kept using (lang) group by lang),
own as (select lang, source, term, count(*) n from terms semi join kept using (lang, term) group by all),
sources as (
  select d.lang, d.source, v, coalesce(total, 0) total from (select distinct lang, source from d) d
  join (select lang, v from langs) l using (lang) left join (select lang, source, sum(n) total from own group by all) o using (lang, source)),
p as (
  select s.lang, s.source, k.term, coalesce(o.n, 0) n,
         1 + cast(1000000000 as hugeint) * (coalesce(o.n, 0) + 5) // (s.total + 5 * s.v) p,
         1 + cast(1000000000 as hugeint) * (k.n + 5) // (l.total + 5 * s.v) q
  from sources s join langs l using (lang) join kept k using (lang) left join own o on o.lang = s.lang and o.source = s.source and o.term = k.term),
apart as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) f
          from sources a join sources b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
more as (select lang, source, 'term' part, term item, p - q f from p where n > 0 and p > q)
select lang, source, part, item, cast(f as bigint) "value", cast(row_number() over (partition by lang, source, part order by f desc, item) as int) "rank"
from (from pairs union all from more) x qualify part = 'pair' or "rank" <= 50
"""


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the texts whose crc32 of the id is divisible by 10, words from a place on repeat with a
    period; both follow from the crc32 and the number of words. The other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("int")

        def word(i: Column) -> Column:
            return F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise("")

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


@query
def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, of which every tenth has planted repeats."""
    found = word_runs.find_runs(with_planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    shown = found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.n")).alias("length"),
        F.col("top.period").alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return shown.withColumn("exponent_milli", F.floor(1000 * F.col("length") / F.col("period")))


ORACLES["op13_word_runs"] = r"""
with crc as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
ids as (select distinct doc_id from documents where doc_id is not null),
hashed as (
  select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) h from ids, crc),
split as (
  select documents.doc_id, h, h // 10 g, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') w
  from documents left join hashed using (doc_id)),
places as (select *, len(w) n, case when len(w) > 0 then g % len(w) end a from split),
periods as (select *, 1 + (n - a) // (3 + g % 8) p from places),
docs as (
  select row_number() over () d, doc_id, n,
         case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end w
  from periods),
words as (select d, n, unnest(range(n)) i, unnest(w) w from docs),
same as (
  select x.d, y.i - x.i q, x.i, x.i - row_number() over (partition by x.d, y.i - x.i order by x.i) island
  from words x join words y on x.d = y.d and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
stretches as (select d, min(i) s, count(*) + q l, q from same group by d, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (
  select * from stretches r where not exists (
    select 1 from stretches o where o.d = r.d and o.q < r.q and o.s <= r.s and o.s + o.l >= r.s + r.l)),
listed as (
  select d, count(*) n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) lines,
         list_sort(list([-l, s, q]))[1] top
  from runs group by d),
gone as (select distinct d, unnest(range(s + q, s + l)) i from runs),
stay as (select d, string_agg(w, ' ' order by i) t from words anti join gone using (d, i) group by d)
select doc_id, coalesce(n_runs, 0) n_runs, cast(top[2] as bigint) start, cast(-top[1] as bigint) length, cast(top[3] as bigint) period,
       cast(1000 * -top[1] // top[3] as bigint) exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
from docs left join listed using (d) left join stay using (d)
"""
