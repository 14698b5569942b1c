"""One registered query per operator, with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.bpe_transducer import encode_documents
from tallyloom.llm.chat_format import digest
from tallyloom.llm.embedding_lsh import near_duplicates as near_vectors
from tallyloom.llm.exact_dedup import exact_dedup
from tallyloom.llm.hyperminhash import near_duplicates as near_texts
from tallyloom.llm.language_hdc import identify
from tallyloom.llm.language_model import score_documents as score_likelihood
from tallyloom.llm.packing import pack
from tallyloom.llm.license_scan import ANCHORS, NEED, SLACK, TEMPLATES, licenses
from tallyloom.llm.prefix_trie import rebuilt_trie
from tallyloom.llm.quality_gam import score_documents as score_quality
from tallyloom.llm.source_divergence import divergence
from tallyloom.llm.tables import read
from tallyloom.llm.warc import round_trip

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]"


#: The text of both turns of conversation -7.
PROBE = "\\### Assistant: </turn> ok"


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, turn, role, PROBE) for turn, role in enumerate(("user", "assistant"))]
    return digest(spark, conversations.unionByName(spark.createDataFrame(extra, conversations.schema)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, read(spark, sf_dir, "pages"))


def op4_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_likelihood(spark, read(spark, sf_dir, "documents"))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(spark, read(spark, sf_dir, "documents"), words=2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, read(spark, sf_dir, "documents"))


def op7_language_hdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, read(spark, sf_dir, "documents"))


def op8_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, read(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, read(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark, read(spark, sf_dir, "conversations"))


OP2_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
f as (
  select *, '### ' || replace(replace(role, '\', '\\'), chr(10), '\n') || ':' || chr(10)
    || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')
    || chr(10) || '</turn>' || chr(10) as formatted
  from t),
c as (select *, coalesce(sum(length(formatted)) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as before from f)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
       cast(sum(length(formatted)) as bigint) as formatted_chars,
       count(*) filter (role = 'assistant') as n_examples,
       cast(sum(case when role = 'assistant' then before else 0 end) as bigint) as context_chars,
       true as contexts_match
from c group by conv_id
"""

OP3_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
         max(page_id) over (partition by coalesce(html, '')) as last_id
  from pages)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id < last_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < last_id then last_id end as refers_to,
       true as complete
from p
"""

OP5_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
         else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from w),
u as (select s, min(doc_id) as rep, len(s) as n from (select doc_id, list_sort(s) as s from s where len(s) > 0) group by s),
x as (select rep, n, unnest(s) as g from u),
pairs as (
  select a.rep as a, b.rep as b, count(*) as shared
  from x a join x b on a.g = b.g and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (
  select rep, rep from u
  union
  select r.a, l.b from reach r join both_ways l on r.b = l.a),
c as (select a as rep, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(len(s.s), 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) as kept
from documents d join s using (doc_id)
left join u on u.s = list_sort(s.s) left join c using (rep)
"""

OP6_SQL = rf"""
with t as (
  select doc_id, length(coalesce(text, '')) as n_chars,
         sha256(regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       text_sha256
from t
window w as (partition by text_sha256 order by n_chars desc, doc_id asc)
"""

OP8_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (
  select vec_id, vec_id from v
  union
  select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a),
n as (select a as vec_id, count(*) as n_links from links group by a)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept
from c left join n using (vec_id)
"""

OP11_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
t as (select lang, source, r, unnest(w) as term from d),
kept as (select lang, term, count(*) as lang_n from t group by lang, term having count(distinct r) >= 30),
langs as (select lang, count(*) as v, sum(lang_n) as n from kept group by lang),
occurring as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by lang, source, term),
sums as (select lang, source, sum(n) as n from c group by lang, source),
g as (select o.lang, o.source, coalesce(s.n, 0) as n, coalesce(l.v, 0) as v, coalesce(l.n, 0) as lang_n
  from occurring o left join sums s using (lang, source) left join langs l using (lang)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
       1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v)::hugeint as p,
       1 + (1000000000::hugeint * (k.lang_n + 5)) // (g.lang_n + 5 * g.v)::hugeint as q
  from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, p - q from p where n > 0 and p > q),
k as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from k where part = 'pair' or rank <= 50
"""

#: Words of the templates (t, label, base, p, word, n words, n needed) and of their key phrases (t, m, place in the template, k, word, n words).
_TEMPLATE_WORDS = ", ".join(
    f"({i}, '{t.label}', {t.base}, {p}, '{w}', {len(t.words.split())}, {len({*t.words.split()}) if t.base else NEED})" for i, t in enumerate(TEMPLATES) for p, w in enumerate(t.words.split())
)
_PHRASE_WORDS = ", ".join(
    f"({i}, {m}, {f' {t.words} '.partition(f' {phrase} ')[0].count(' ')}, {0 if t.base else SLACK}, {k}, '{w}', {len(phrase.split())})"
    for i, t in enumerate(TEMPLATES) for m, phrase in enumerate(t.phrases) for k, w in enumerate(phrase.split())
)

OP12_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
tw(t, label, base, p, word, n, needed) as (values {_TEMPLATE_WORDS}),
mw(t, m, place, slack, k, word, n) as (values {_PHRASE_WORDS}),
vocabulary as (select distinct word from tw),
w as (select r, word, pos from (select r, unnest(words) as word, unnest(range(len(words))) as pos from d) join vocabulary using (word)),
rare as (select word, count(distinct r) as texts from w group by word),
anchors as (
  select r, t, word from (select distinct w.r, tw.t, w.word, rare.texts from w join tw using (word) join rare using (word))
  qualify row_number() over (partition by r, t order by texts, word) <= {ANCHORS}),
starts as (
  select w.r, tw.t, w.pos - tw.p as start from anchors a join w on w.r = a.r and w.word = a.word join tw on tw.t = a.t and tw.word = a.word
  group by w.r, tw.t, w.pos - tw.p having count(distinct w.word) >= min(tw.needed)),
phrases as (
  select w.r, mw.t, mw.m, w.pos - mw.k as start, min(mw.place) as place, min(mw.slack) as slack from w join mw using (word)
  group by w.r, mw.t, mw.m, w.pos - mw.k having count(*) = min(mw.n)),
proven as (
  select s.r, s.t, s.start from starts s join phrases f on f.r = s.r and f.t = s.t and f.start between s.start + f.place - f.slack and s.start + f.place + f.slack
  group by s.r, s.t, s.start having count(distinct f.m) = (select count(distinct m) from mw where mw.t = s.t)),
shared as (
  select p.r, p.t, p.start, tw.label, tw.base, count(w.word) / min(tw.n)::double as share
  from proven p join tw on tw.t = p.t left join w on w.r = p.r and w.pos = p.start + tw.p and w.word = tw.word
  group by all),
found as (
  select r, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
         string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from shared group by r)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join found using (r)
"""

OP13_SQL = r"""
with o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, step: xor(x >> 1, (x & 1) * 3988292384)))) % 6 as h
  from (select distinct conv_id from o)),
r as (
  select conv_id, pos, role, text from o join c using (conv_id) where pos >= h or conv_id = base
  union all
  select c.conv_id, o.pos, o.role, o.text from c join o on o.conv_id = c.base where c.conv_id <> c.base and o.pos < c.h),
p as (
  select conv_id, row_number() over w as depth, length(text) as chars, string_agg(sha256(role) || sha256(text), '') over w as path
  from r window w as (partition by conv_id order by pos)
  union all select conv_id, 0, 0, '' from c),
m as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * min(chars) as saved from p group by depth, path),
k as (
  select m.*, left(path, 128 * (depth - 1)) as up, (select count(*) from m x where x.depth = m.depth + 1 and left(x.path, length(m.path)) = m.path) as n_children from m),
below as (
  select distinct a.depth as depth, a.path as path, b.depth as low_depth, b.path as low
  from p a join p b on a.conv_id = b.conv_id and b.depth >= a.depth),
sums as (
  select below.depth, below.path, sum(case when k.n_children = 0 then 1 else 0 end) as n_leaves, sum(k.saved) as saved_tokens
  from below join k on k.depth = below.low_depth and k.path = below.low group by below.depth, below.path),
ends as (
  select depth, path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256
  from (select *, max(depth) over (partition by conv_id) as deepest from p) where depth = deepest group by depth, path)
select k.conv_id, k.depth, parents.conv_id as parent_conv_id, k.n_convs, k.n_children, cast(n_leaves as bigint) as n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from k join sums using (depth, path) left join ends using (depth, path)
left join m parents on parents.depth = k.depth - 1 and parents.path = k.up
"""

QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_chat_format": op2_chat_format,
    "op3_warc": op3_warc,
    "op4_gru_language_model": op4_gru_language_model,
    "op5_hyperminhash": op5_hyperminhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_hdc": op7_language_hdc,
    "op8_embedding_lsh": op8_embedding_lsh,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op2_chat_format": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op5_hyperminhash": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_embedding_lsh": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
