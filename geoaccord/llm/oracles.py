"""SQL of the queries of this package that another engine can run over the same tables.

The others have none: their gzip members, models, merges, grammars and edit distances are beyond SQL, and their tests
hold them against brute force, public libraries and round trips.
"""

from __future__ import annotations

from .linededup import MIN_CHARS, MIN_DOCS
from .jaccard import PERCENT, WORDS
from .quality import ANCHOR, EM_ROUNDS, RULES, START

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quality() -> str:
    """Counts, votes, the rounds of the fit over the vote patterns, one step a round, and the verdicts."""
    n = len(RULES)
    shares = {kind: [float(x) for x in START[kind]] * n for kind in ("good", "bad")}

    def odds(rule: int, source: str) -> str:
        return f"ln(list_extract({source}.good, {3 * rule + 2} + v[{rule + 1}]) / list_extract({source}.bad, {3 * rule + 2} + v[{rule + 1}]))"

    def posterior(source: str) -> str:
        return f"1 / (1 + exp(-(ln({source}.pi / (1 - {source}.pi)) + {' + '.join(odds(j, source) for j in range(n))})))"

    def fitted(weight: str, prior: list[float]) -> str:
        terms = [f"((sum(case when v[{k // 3 + 1}] = {k % 3 - 1} then {weight} else 0 end) + 1) / (sum({weight}) + 3) + {ANCHOR} * {prior[k]!r}::double) / {1 + ANCHOR}" for k in range(3 * n)]
        return f"[{', '.join(terms)}]"

    steps = [f"p0 as (select {START['pi']}::double as pi, {shares['good']}::double[] as good, {shares['bad']}::double[] as bad)"]
    for k in range(EM_ROUNDS):
        scored = f"(select v, n, {posterior(f'p{k}')} as q from patterns, p{k})"
        steps.append(f"p{k + 1} as materialized (select (sum(n * q) + 1) / (sum(n) + 2) as pi, {fitted('n * q', shares['good'])} as good, {fitted('n * (1 - q)', shares['bad'])} as bad from {scored})")
    rule = lambda good, bad: f"case when {bad} then -1 when {good} then 1 else 0 end"
    votes = [
        rule("n_words >= 50 and n_words <= 100000", "n_words < 50"), rule("n_symbols * 50 <= n_words", "n_words = 0 or n_symbols * 5 >= n_words"),
        rule("n_lines >= 2 and n_dup_lines * 10 <= n_lines", "n_dup_lines >= 3 and n_dup_lines * 2 >= n_lines"), rule("n_repeat_words * 10 <= n_words", "n_repeat_words * 10 > n_words * 3"),
        rule("n_capitals * 5 <= word_chars", "n_capitals * 5 > word_chars * 2"), rule("n_marks * 50 <= n_words", "n_words = 0 or n_marks * 5 >= n_words"),
        rule("n_bare * 50 <= n_words", "n_words = 0 or n_bare * 5 >= n_words"), rule("n_distinct * 5 >= least(n_words, 200)", "n_words = 0 or n_distinct * 10 < least(n_words, 200)"),
    ]
    return rf"""with d as materialized (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
  w as materialized (select row, doc_id, text, {_WORDS} as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
  win as (select row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from (select row, words, unnest(range(1, len(words) - 1)) as i from w)),
  rep as (select row, count(distinct p) as n_repeat_words from (select row, unnest([i, i + 1, i + 2]) as p from (select row, i, count(*) over (partition by row, g) as c from win) where c > 1) group by row),
  f as materialized (select w.row, doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(list_distinct(words)) as n_distinct, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) as n_capitals,
    len(regexp_extract_all(text, '[!?.,;:#*$%&|<>_=~-]{{2,}}')) as n_marks, len(list_filter(words, lambda x: regexp_full_match(x, '[^\p{{L}}\p{{N}}]+'))) as n_bare from w left join rep on rep.row = w.row),
  vo as materialized (select *, [{', '.join(votes)}] as v from f), patterns as materialized (select v, count(*)::double as n from vo group by v),
  {', '.join(steps)}, post as (select v, {posterior(f'p{EM_ROUNDS}')} as posterior from patterns, p{EM_ROUNDS}),
  r as (select vo.*, posterior, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from vo join post on post.v = vo.v)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and posterior >= 0.5 as kept, round(posterior, 6) as posterior from r"""


def sharding(shards: int = 8) -> str:
    """Rendezvous hashing with equal weights: the shard with the largest 52 bits of an MD5 digest; CRC-32 by its table."""
    table = "list_reduce(list_prepend(k::bigint, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)"
    digit = lambda k: f"(instr('0123456789ABCDEF', p[{k}]) - 1)"
    best = lambda n: f"(select arg_max(k, (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || k), 1, 13))::bigint, -k)) from range({n}) s(k))"
    return f"""with tab as materialized (select list(v order by k) as t from (select k, {table} as v from range(256) r(k))),
  b as (select doc_id, text, list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: {digit(1)} * 16 + {digit(2)})) as bytes from documents),
  s as (select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32, {best(shards)}::int as shard, {best(shards + 1)}::int as grown_shard from b, tab)
  select doc_id, size::bigint as size, text_crc32, 'key' as law, shard, grown_shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot from s"""


def jaccard() -> str:
    """All pairs that share a shingle, their overlap, and the least id that links reach."""
    grams = f"case when len(words) >= {WORDS} then list_transform(range(1, len(words) - {WORDS - 2}), lambda i: hash(list_slice(words, i, i + {WORDS - 1}))) when len(words) > 0 then [hash(words)] else [] end"
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as words from documents),
  s as materialized (select doc_id, list_distinct(coalesce({grams}, [])) as shingles from w), g as materialized (select doc_id, len(shingles) as n, unnest(shingles) as h from s),
  links as materialized (select a.doc_id as x, b.doc_id as y from g a join g b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
  reach(node, other) as (select doc_id, doc_id from documents union select node, y from reach join links on x = other)
  select s.doc_id, len(shingles) as n_shingles, component_id from s join (select node, min(other) as component_id from reach group by node) on node = s.doc_id"""


def line_dedup() -> str:
    """The documents of each key, and the lines that stay, in their order."""
    key = f"trim(translate(line, '{_UPPER}', '{_UPPER.lower()}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""with d as materialized (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
  l as materialized (select row, place, line, {key} as k from (select row, unnest(lines) as line, unnest(range(len(lines))) as place from d)),
  f as (select k from l where length(k) >= {MIN_CHARS} group by k having count(distinct row) >= {MIN_DOCS}),
  o as (select row, string_agg(line, chr(10) order by place) filter (f.k is null) as kept, count(f.k) as n_dropped from l left join f on l.k = f.k group by row)
  select doc_id, len(lines)::bigint as n_lines, n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from d join o on o.row = d.row"""


def golden_records() -> str:
    """Every field by an order of its own over all records of a cluster."""
    text = lambda c: f"case when regexp_matches({c}, '[^\\x20\\x09-\\x0D]') then {c} end"
    recent = "updated_at desc nulls last, trust desc, client_id nulls last"
    trusted = f"fresh desc, trust desc, {recent}"

    def pick(name: str, columns: str, where: str, order: str) -> str:
        return f"{name} as (select cluster_id, {columns} from (select *, row_number() over (partition by cluster_id order by {order}) as k from s where {where}) where k = 1)"

    parts = [
        pick("a", "segment, client_id as segment_from", "segment is not null", recent), pick("b", "email, client_id as email_from", "email is not null", trusted),
        pick("c", "name, client_id as name_from", "name is not null", f"length(name) desc, {trusted}"),
        pick("d", "city, nation_id, case when filled > 0 then client_id end as address_from", "true", f"filled desc, {trusted}"),
        pick("e", "balance, client_id as balance_from", "balance is not null", f"chosen desc, {recent}").replace(" from s where", " from (select s.*, coalesce(s.segment = a.segment, false) as chosen from s left join a using (cluster_id)) where"),
    ]
    return f"""with r as (select coalesce(master_id, client_id) as cluster_id, client_id, updated_at, coalesce(list_position(['partner', 'store', 'web', 'crm'], source), 0) as trust,
    {text('name')} as name, {text('email')} as email, {text('segment')} as segment, {text('city')} as city, nation_id, balance from clients),
  s as materialized (select *, coalesce(updated_at >= max(updated_at) over (partition by cluster_id) - interval 1440 hour, false) as fresh, (city is not null)::int + (nation_id is not null)::int as filled from r),
  n as (select cluster_id, count(*) as n_records, count(*) filter (not fresh) as n_stale from s group by cluster_id),
  {', '.join(parts)}
  select cluster_id, n_records, n_stale, name, email, segment, city, nation_id, floor(100 * balance + 0.5)::bigint as balance_cents, name_from, email_from, segment_from, balance_from, address_from
  from n left join a using (cluster_id) left join b using (cluster_id) left join c using (cluster_id) left join d using (cluster_id) left join e using (cluster_id)"""


ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality(), "op2_sharding": sharding(), "op7_jaccard_join": jaccard(), "op11_golden_records": golden_records(), "op12_line_dedup": line_dedup()}
