"""Text operators on documents and conversations."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.operators import text as X

LINES_SQL = """raw as (select {key}, i - 1 as line_no, ls[i] as line from (select {key}, string_split(lower({col}), chr(10)) as ls,
  unnest(generate_series(1, len(string_split({col}, chr(10))))) as i from {table}))"""
TOKEN_SQL = """list_filter(string_split(translate(lower({c}), '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 33)), ' '), lambda w: w <> '')"""


@query("text_lines", f"""with {LINES_SQL.format(key='doc_id', col='text', table='documents')}
select doc_id, cast(line_no as int) as line_no, array_to_string(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '' and w <> 'que'), ' ') as line from raw""")
def _lines(t):
    return X.text_lines(t.documents, "doc_id", "text", ["que"])


@query("text_word_freq", """select word, count(*) as n from (select unnest(string_split_regex(lower(text), '\\s+')) as word from documents)
where word <> '' group by word order by n desc, word limit 250""")
def _freq(t):
    return X.word_freq(t.documents, "text", 250)


VOCAB_SQL = f"""vocab as (select token, n, row_number() over (order by n desc, token) as idx from (
  select token, count(*) as n from (select unnest({TOKEN_SQL.replace('{c}', 'text')}) as token from @table) group by token))"""


@query("text_vocab_index", f"with {VOCAB_SQL.replace('@table', 'documents')} select * from vocab")
def _vocab(t):
    return X.vocab(t.documents, "text")


@query("text_ngram_prefixes", f"""with {VOCAB_SQL.replace('@table', 'conversations')},
c as (select conv_id, turn, text from conversations),
{LINES_SQL.format(key='conv_id, turn', col='text', table='c')},
tk as (select conv_id, turn, line_no, unnest(tks) as token, generate_subscripts(tks, 1) as pos from (select conv_id, turn, line_no, {TOKEN_SQL.replace('{c}', 'line')} as tks from raw)),
sq as (select conv_id, turn, line_no, list(idx order by pos) as ids from tk join vocab v on v.token = tk.token group by conv_id, turn, line_no),
w as (select max(len(ids)) as width from sq),
pf as (select conv_id, turn, line_no, unnest(generate_series(1, len(ids) - 1)) as n, ids from sq where len(ids) > 1)
select conv_id, turn, cast(line_no as int) as line_no, cast(n as int) as n_known, width, ids[n + 1] as label,
  md5(array_to_string(list_concat(list_transform(range(0, width - 1 - n), lambda z: 0::bigint), ids[1:n]), ',')) as digest from pf cross join w""")
def _prefixes(t):
    docs = t.conversations.select("conv_id", "turn", "text")
    lines, prefixes = X.ngram_prefixes(docs, ["conv_id", "turn"], "text", X.vocab(docs, "text"), t.scratch("lines"))
    rows = X.padded(lines, prefixes, ["conv_id", "turn"])
    digest = F.md5(F.array_join(F.col("predictors").cast("array<string>"), ","))
    return rows.select("conv_id", "turn", "line_no", "n_known", (F.size("predictors") + 1).cast("long").alias("width"), "label", digest.alias("digest"))


# Three readings of every message.
READINGS = [("0", "text"), ("1", "replace(text, 'ou', 'ov')"), ("2", "replace(replace(text, 'en', 'e n'), 'ou', 'ov')")]
CANDS_SQL = "cands as (" + " union all ".join(f"select conv_id, turn, {i} as cand, {e} as text from conversations" for i, e in READINGS) + ")"
# The check's edit distance counts bytes: letters beyond ASCII stand for single control characters there, one for each.
BYTES_SQL = """letters as (select string_agg(c, '' order by c) as have from (select distinct unnest(regexp_extract_all(text, '[^ -~\\n]')) as c from conversations)),
controls as (select string_agg(chr(i::int), '' order by i) as give from (select unnest(list_concat(range(1, 9), range(14, 32))) as i))"""
BYTES = "translate({0}, coalesce((select have from letters), ''), (select left(give, coalesce(length(have), 0)::bigint) from letters, controls))"
VOTE_SQL = CANDS_SQL + """,
ln as (select conv_id, turn, cand, string_split(text, chr(10)) as ls from cands),
l2 as (select conv_id, turn, cand, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from ln),
wd as (select conv_id, turn, cand, line_no, list_concat([''], list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) as ws from l2),
w2 as (select conv_id, turn, cand, line_no, unnest(ws) as word, generate_subscripts(ws, 1) as pos from wd),
g1 as (select conv_id, turn, line_no, pos, word, count(*) as n, min(cand) as first from w2 group by all),
g2 as (select *, sum(n) over (partition by conv_id, turn, line_no, pos) as have,
  row_number() over (partition by conv_id, turn, line_no, pos order by n desc, first) as rn from g1),
l3 as (select conv_id, turn, line_no, coalesce(string_agg(word, ' ' order by pos) filter (pos > 1), '') as line from g2 where rn = 1 and have = 3 group by all),
voted as (select conv_id, turn, string_agg(line, chr(10) order by line_no) as vote from l3 group by conv_id, turn)"""
MESSAGE = ["conv_id", "turn"]


def cands(t):
    swapped = F.replace("text", F.lit("ou"), F.lit("ov"))
    split = F.replace(F.replace("text", F.lit("en"), F.lit("e n")), F.lit("ou"), F.lit("ov"))
    return t.conversations.select(*MESSAGE, F.posexplode(F.array("text", swapped, split)).alias("cand", "text"))


@query("text_vote_words", f"with {VOTE_SQL} select conv_id, turn, vote as text from voted")
def _vote(t):
    return X.vote(cands(t), MESSAGE, "cand", "text")


@query("text_pick_best", f"""with {BYTES_SQL}, {VOTE_SQL},
s as (select a.conv_id, a.turn, a.cand, a.text, cast(sum(case when a.text = b.text then 0 else levenshtein({BYTES.format('a.text')}, {BYTES.format('b.text')}) end) as bigint) as total
  from cands a join cands b on b.conv_id = a.conv_id and b.turn = a.turn group by all),
best as (select * from (select *, row_number() over (partition by conv_id, turn order by total, cand) as rn from s) where rn = 1)
select c.conv_id, c.turn, cand, text, cast(levenshtein({BYTES.format('c.text')}, {BYTES.format('v.vote')}) as int) as distance
  from best c join voted v on v.conv_id = c.conv_id and v.turn = c.turn""")
def _best(t):
    return X.pick_best(cands(t), MESSAGE, "cand", "text").drop("total")


@query("text_error_rates", f"""with {BYTES_SQL}, b as (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from conversations),
c as (select conv_id, turn, w, array_to_string(w, ' ') as truth, w[1:greatest(len(w) - turn % 3, 0)] as v from b)
select conv_id, turn, round(levenshtein({BYTES.format('truth')}, {BYTES.format("array_to_string(v, ' ')")}) / nullif(length(truth), 0), 6) as cer,
  round((len(w) - len(v)) / nullif(len(w), 0), 6) as wer from c""")
def _errors(t):
    rows = t.conversations.select(*MESSAGE, X.split_words(F.col("text")).alias("w"))
    kept = F.slice("w", F.lit(1), F.greatest(F.size("w") - F.col("turn").cast("int") % 3, F.lit(0)))
    rows = rows.select(*MESSAGE, F.array_join("w", " ").alias("truth"), F.array_join(kept, " ").alias("got"))
    out = X.error_rates(rows, "truth", "got")
    return out.select(*MESSAGE, *[F.round(c, 6).alias(c) for c in ("cer", "wer")])


@query("udf_rowwise", """select event_id, case when event_type = 'purchase' and value > 50 then 'large' when event_type = 'purchase' then 'small'
  when event_type = 'error' then 'check' else 'other' end as rule, round(value * case when event_type = 'purchase' then 2 else 1 end, 6) as weighted from events""")
def _rowwise(t):
    kind, value = F.col("event_type"), F.col("value")
    rule = F.when((kind == "purchase") & (value > 50), "large").when(kind == "purchase", "small").when(kind == "error", "check").otherwise("other")
    return t.events.select("event_id", rule.alias("rule"), F.round(value * F.when(kind == "purchase", 2).otherwise(1), 6).alias("weighted"))
