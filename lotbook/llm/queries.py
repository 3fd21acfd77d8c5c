"""The registered queries of this package, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotbook.llm import brown, html_text, lexical, linedup, merkle, mixing, neardup, packing, pii, quality, urls, vectors, wavelet
from lotbook.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_brown_scores")
def brown_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = brown.train(docs, brown.held_out())
    return brown.score(docs, model, brown.held_out()).select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_quality_rules")
def quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("row.doc_id", *quality.COUNTS, "base_failed", "kept", "margin")


# Lines by words; a line goes if an earlier one has the same words, or shares a deletion variant of one word.
LINE_DEDUP = """
with lines as (
    select doc_id, place, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words
    from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place
          from documents where text is not null)),
kept as (select doc_id, place, words, len(words) as n, list_aggregate(words, 'string_agg', ' ') as line from lines where len(words) >= 5),
firsts as (select line, any_value(words) as words, any_value(n) as n, min((doc_id, place)) as ord from kept group by line),
cut as (
    select line, ord, n, i, list_aggregate(list_concat(words[:i - 1], words[i + 1:]), 'string_agg', ' ') as variant
    from (select *, unnest(range(1, n + 1)) as i from firsts where n >= 11)),
near as (
    select a.line from cut a join cut b on a.n = b.n and a.i = b.i and a.variant = b.variant and b.ord < a.ord
    union select a.line from cut a join firsts b on a.variant = b.line and b.n >= 11 and b.ord < a.ord
    union select a.line from firsts a join cut b on b.variant = a.line and b.ord < a.ord where a.n >= 11),
gone as (
    select k.doc_id, k.place from kept k join firsts f using (line) where (k.doc_id, k.place) <> f.ord
    union select k.doc_id, k.place from kept k join near using (line)),
per_doc as (select doc_id, list_sort(list(place)) as dropped, count(*) as n_dropped from gone group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(text, chr(10))), 0) as integer) as n_lines,
       cast(coalesce(n_dropped, 0) as integer) as n_dropped,
       coalesce(list_aggregate(dropped, 'string_agg', ','), '') as dropped
from documents d left join per_doc using (doc_id)
"""


@query("op3_line_dedup", LINE_DEDUP)
def line_dedup(spark, sf_dir):
    found = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", F.size("dropped").alias("n_dropped"),
                        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


@query("op5_mix_sources")
def mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# All pairs that share a shingle, compared on their sets; components by the smallest number that can be reached.
NEAR_DUPLICATES = """
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
shingles as (
    select distinct doc_id, list_aggregate(words[i:i + 4], 'string_agg', ' ') as s
    from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from words where len(words) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
    select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * shared >= 75 * (x.n + y.n - shared)),
edges as (select a, b from links union select b, a from links),
reach as (
    select doc_id as a, doc_id as b from documents
    union select r.a, e.b from reach r join edges e on r.b = e.a),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from least left join sizes using (doc_id)
"""


@query("op6_near_duplicates", NEAR_DUPLICATES)
def near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


@query("op9_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), word_bpe_path()))


@query("op7_main_text")
def main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = html_text.main_texts(pages, html_text.fit(pages))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op10_nearest_vectors")
def nearest_vectors(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


# The longest rule that fits; else the character models, with the same counts, smoothing and calibration.
URL_FILTER = """
with cut as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
    select page_id, url, regexp_extract(rest, '^([^/?#]*)', 1) as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
named as (
    select page_id, coalesce(md5(url), 'd41d8cd98f00b204e9800998ecf8427e') < '3' as held,
           translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
ruled as (
    select *, case
        when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
        when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from named),
texts as (
    select *, coalesce(rule in ('com/', 'www.example.com/en/'), false) as allowed,
           coalesce(rule in ('example.com/en/', 'net/es/', 'net/fr/'), false) as blocked,
           regexp_replace(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[0-9]', '0', 'g'), '[^a-z0./-]', '~', 'g') as text from ruled),
cuts as (
    select page_id, allowed, blocked, held, substr('^^^' || text || '$', i, 4) as gram
    from (select *, unnest(range(1, len(text) + 2)) as i from texts)),
grams as (
    select gram, count(*) filter (allowed and not held) as a, count(*) filter (blocked and not held) as r from cuts group by 1),
c0 as (select substr(gram, 4, 1) as g, sum(a) as a, sum(r) as r from grams group by 1),
p0 as (select g, (a + 1.0) / (select sum(a) + 33 from grams) as pa, (r + 1.0) / (select sum(r) + 33 from grams) as pr from c0),
c1 as (select substr(gram, 3, 2) as g, sum(a) as a, sum(r) as r from grams group by 1),
x1 as (select substr(g, 1, 1) as c, sum(a) as na, sum(r) as nr, count(*) filter (a > 0) as ka, count(*) filter (r > 0) as kr from c1 group by 1),
p1 as (
    select c1.g, case when na > 0 then (a + ka * pa) / (na + ka) else pa end as pa, case when nr > 0 then (r + kr * pr) / (nr + kr) else pr end as pr
    from c1 join x1 on x1.c = substr(c1.g, 1, 1) join p0 on p0.g = substr(c1.g, 2, 1)),
c2 as (select substr(gram, 2, 3) as g, sum(a) as a, sum(r) as r from grams group by 1),
x2 as (select substr(g, 1, 2) as c, sum(a) as na, sum(r) as nr, count(*) filter (a > 0) as ka, count(*) filter (r > 0) as kr from c2 group by 1),
p2 as (
    select c2.g, case when na > 0 then (a + ka * pa) / (na + ka) else pa end as pa, case when nr > 0 then (r + kr * pr) / (nr + kr) else pr end as pr
    from c2 join x2 on x2.c = substr(c2.g, 1, 2) join p1 on p1.g = substr(c2.g, 2, 2)),
c3 as (select substr(gram, 1, 4) as g, sum(a) as a, sum(r) as r from grams group by 1),
x3 as (select substr(g, 1, 3) as c, sum(a) as na, sum(r) as nr, count(*) filter (a > 0) as ka, count(*) filter (r > 0) as kr from c3 group by 1),
p3 as (
    select c3.g, case when na > 0 then (a + ka * pa) / (na + ka) else pa end as pa, case when nr > 0 then (r + kr * pr) / (nr + kr) else pr end as pr
    from c3 join x3 on x3.c = substr(c3.g, 1, 3) join p2 on p2.g = substr(c3.g, 2, 3)),
scored as (select page_id, sum(ln(pa) - ln(pr)) / count(*) as score from cuts join p3 on p3.g = cuts.gram group by 1),
facts as (
    select avg(score) filter (allowed and held) as ma, avg(score) filter (blocked and held) as mr,
           stddev_pop(score) filter (allowed and held) as sa, stddev_pop(score) filter (blocked and held) as sr,
           count(*) filter (allowed and not held) as na, count(*) filter (blocked and not held) as nr from texts join scored using (page_id)),
bound as (
    select na > 0 and nr > 0 as known, case when ma is null or mr is null or ma <= mr then 0
        when sa + sr = 0 then (ma + mr) / 2 else (ma * sr + mr * sa) / (sa + sr) end as t from facts)
select page_id, host, path, rule, case when allowed then 'allow' when blocked then 'block'
       when known and score < t then 'block' else 'allow' end as verdict
from texts join scored using (page_id) cross join bound
"""
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op8_url_filter", URL_FILTER)
def url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES).select("row.page_id", "host", "path", "rule", "verdict")


@query("op4_surrogates")
def surrogates(spark, sf_dir):
    found = pii.replace_entities(table(spark, sf_dir, "documents"), key="lotbook")
    return found.select("row.doc_id", "text", "n_replaced", "kinds")


@query("op11_token_files")
def token_files(spark, sf_dir):
    """Written as wavelet matrices, and read back from these files."""
    folder = scratch_path(spark, "token-files")
    wavelet.write(table(spark, sf_dir, "documents"), folder, word_bpe_path())
    return wavelet.read_documents(spark, folder)


# All nodes of each tree as lists, one list a level; the way of each leaf as a list of siblings with their side.
MERKLE = """
with recursive table_of as (
    select list(list_reduce(list_concat([i], range(8)), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
    from (select unnest(range(256)) as i)),
summed as (
    select *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as bigint))),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 as tampered
    from documents, table_of),
fields as (
    select *, row_number() over () as rid,
           concat(coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                  coalesce(strlen(lang) || ':' || lang, '-')) as front,
           coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as own,
           coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') as other,
           coalesce(strlen(text) || ':' || text, '-') as rest
    from summed),
leaves as (
    select rid, doc_id, lang, sha256(concat(front, own, rest)) as leaf,
           sha256(concat(front, case when tampered then other else own end, rest)) as candidate from fields),
placed as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
           dense_rank() over (order by lang nulls first) - 1 as g from leaves),
trees as (
    select g, 0 as level, list(leaf order by pos) as nodes from placed group by g
    union all
    select g, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from trees where len(nodes) > 1),
subroots as (select g, nodes[1] as subroot from trees where len(nodes) = 1),
tops as (
    select 0 as level, list(subroot order by g) as nodes from subroots
    union all
    select level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from tops where len(nodes) > 1),
steps as (
    select rid, level as step, pos >> level as spot, nodes from placed join trees using (g) where len(nodes) > 1
    union all
    select rid, 1000 + level, g >> level, nodes from placed, tops where len(nodes) > 1),
ways as (
    select rid, list(case when spot % 2 = 1 then 'L' || nodes[spot] else 'R' || coalesce(nodes[spot + 2], '') end order by step) as way
    from steps group by rid)
select doc_id, leaf, subroot, r.nodes[1] as root, sha256(coalesce(list_aggregate(list_transform(way, lambda x: substr(x, 2)), 'string_agg', ''), '')) as proof_sha256,
       list_reduce(list_concat([candidate], coalesce(way, [])),
           lambda h, x: case when x[1] = 'L' then sha256(substr(x, 2) || h) else sha256(h || substr(x, 2)) end) as folded_root,
       folded_root = root as verified
from placed join subroots using (g) left join ways using (rid), (select nodes from tops where len(nodes) = 1) r
"""


@query("op13_merkle_manifest", MERKLE)
def merkle_manifest(spark, sf_dir):
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


# The terms of all documents, counted, joined with those of the items.
LEXICAL = """
with words as (
    select rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select *, row_number() over () as rid from documents)),
counted as (select rid, doc_id, term, count(*) as tf from words group by all),
sizes as (select rid, sum(tf) as n from counted group by 1),
totals as (select count(*) as nd, sum(n) as len from sizes),
wanted as (
    select distinct iid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select *, row_number() over () as iid from benchmark)),
weights as (
    select term, cast(floor(1000 * ln(cast(2 * nd + 2 as double) / (2 * df + 1))) as bigint) as w
    from (select term, count(*) as df from counted where term in (select term from wanted) group by 1), totals),
scores as (
    select iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // len)))) as score
    from wanted join weights using (term) join counted using (term) join sizes using (rid), totals group by all),
ranked as (
    select *, row_number() over (partition by iid order by score desc, doc_id nulls last) as place from scores where score > 0)
select item_id, cast(place as integer) as rank, doc_id, cast(score as bigint) as score from ranked where place <= 50
"""


@query("op12_lexical_search", LEXICAL)
def lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
