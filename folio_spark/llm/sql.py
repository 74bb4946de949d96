"""SQL that the queries of this subpackage are checked against: plain definitions of the results, by other ways than the operators'."""

from __future__ import annotations

# The letters A-Z alone are lower-cased; words end at space, tab, line feed, vertical tab, form feed and carriage return.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# Every pair of equal lines lies on a diagonal of two documents; unbroken stretches of a diagonal are runs of lines in common.
LINE_DEDUP = rf"""
with split as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
every as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) pos from split),
counted as (select doc_id, pos, line, len({WORDS.format('line')}) n_words from every),
lines as (select doc_id, pos, line, n_words, row_number() over w as nth, sum(n_words) over w as words from counted where n_words > 0 window w as (partition by doc_id order by pos)),
pairs as (select b.doc_id, b.nth, a.doc_id other, b.nth - a.nth diagonal from lines a join lines b on a.line = b.line and (a.doc_id < b.doc_id or a.doc_id = b.doc_id and a.nth < b.nth)),
islands as (select *, nth - row_number() over (partition by doc_id, other, diagonal order by nth) island from pairs),
runs as (select doc_id, nth, max(nth) over (partition by doc_id, other, diagonal, island) stop from islands),
longest as (select doc_id, nth, max(stop) stop from runs group by all),
good as (select x.doc_id, x.nth, x.stop from longest x join lines a on a.doc_id = x.doc_id and a.nth = x.nth join lines z on z.doc_id = x.doc_id and z.nth = x.stop where z.words - a.words + a.n_words >= {{min_words}}),
reached as (select l.doc_id, l.pos, max(g.stop) over (partition by l.doc_id order by l.nth) >= l.nth gone from lines l left join good g on g.doc_id = l.doc_id and g.nth = l.nth),
gone as (select doc_id, pos from reached where gone),
left_over as (select e.doc_id, string_agg(e.line, chr(10) order by e.pos) text from every e anti join gone using (doc_id, pos) group by e.doc_id),
lost as (select doc_id, count(*) n from gone group by doc_id)
select d.doc_id, case when n is null then d.text else coalesce(o.text, '') end as text, coalesce(n, 0)::int n_removed from documents d left join lost using (doc_id) left join left_over o on o.doc_id = d.doc_id"""

# Equal sets stand as one; all pairs that share a shingle are counted, and links are followed until nothing new is reached.
NGRAM_JACCARD = rf"""
with recursive w as (select doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} w from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end)) s from w),
classes as (select s, min(doc_id) rep, len(s) n from sets where len(s) > 0 group by s),
posts as (select rep, n, unnest(s) g from classes),
links as (select a.rep a, b.rep b from posts a join posts b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(id, other) as (select rep, rep from classes union select id, b from reach join both_ways on other = a),
roots as (select id, min(other) root from reach group by id)
select doc_id, len(sets.s)::bigint n_shingles, coalesce(root, doc_id) component_id from sets left join classes on sets.s = classes.s left join roots on id = rep"""

# Every bucket of every depth is summed; a document's shard is the first on its way down that may stay whole.
SHARDING = """
with h as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint h, coalesce(strlen(text), 0) b from documents),
down as (select *, h >> (32 - d) p from h, (select unnest(range(0, 33)) d)),
buckets as (select d, p, sum(b) <= {max_bytes} or min(h) = max(h) or d = 32 ends from down group by d, p),
found as (select doc_id, b, h, min(d) depth from down join buckets using (d, p) where ends group by all)
select doc_id, case when depth = 0 then '' else lpad(bin(h >> (32 - depth)), depth::int, '0') end shard, depth::int depth, b::bigint n_bytes from found"""

# Digests straight from the table; the length of all windows from the turns each holds anew or again.
CHAT_FORMAT = """
with given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from (values (-7, 0, 'user', '{probe}'), (-7, 1, 'assistant', '{probe}')) v),
sized as (select *, ceil(strlen(text) / 4)::bigint + 8 cost, 11 + length(role || text) + length(regexp_replace(role || text, '[^\\\\<\\[\\]]', '', 'g')) chars from given),
turns as (select *, row_number() over w as ord, sum(cost) over w - cost as before, count(*) over (partition by conv_id) n from sized window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)),
heads as (select conv_id, chars, cost from turns where ord = 1 and role = 'system'),
room as (select t.*, coalesce(h.cost, 0) lead, greatest((1024 - 256 - coalesce(h.cost, 0)) // 2, 64) half from turns t left join heads h using (conv_id)),
slots as (select *, (before - case when ord > 1 then lead else 0 end) // half slot, case when cost > half and not (ord = 1 and role = 'system') then ord else 0 end alone from room),
fresh as (select *, min(ord) over s first_ord, max(ord) over s last_ord from slots window s as (partition by conv_id, slot, alone)),
tails as (select *, sum(cost) over (partition by conv_id, first_ord order by ord desc) kept from fresh where last_ord - ord < 2 and last_ord < n),
again as (select conv_id, sum(chars) chars from tails where kept <= 256 and not (ord = 1 and role = 'system') group by conv_id),
repeats as (select conv_id, count(*) filter (first_ord > 1 and ord = first_ord) windows from fresh group by conv_id)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by ord)) turns_sha256,
 length(coalesce(string_agg(text, '' order by ord) filter (role = 'assistant'), '')) loss_chars, sha256(coalesce(string_agg(text, '' order by ord) filter (role = 'assistant'), '')) loss_sha256,
 (sum(turns.chars) + coalesce(any_value(again.chars), 0) + coalesce(any_value(heads.chars * windows), 0))::bigint formatted_chars
from turns left join again using (conv_id) left join heads using (conv_id) left join repeats using (conv_id) group by conv_id"""

# The strength with the largest beta-binomial likelihood over units (n, k, prior); a unit's prior is of the others above it.
STRENGTH = "(select coalesce(first(s order by l desc, s), 1.0) from (select s, sum(lgamma(k + s * prior) - lgamma(s * prior) + lgamma(n - k + s - s * prior) - lgamma(s - s * prior) - lgamma(n + s) + lgamma(s)) l from {0}, (select 2.0::double ** unnest(range(-2, 11)) s) group by s))"
URL_FILTERS = rf"""
with seen as (select page_id, url, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
known as (select page_id, max(bad) bad from (select page_id, try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]+/(\d{{{{1,18}}}})', 1) as bigint) doc_id from pages)
 join (select doc_id, max((coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1)::int) bad from labels group by doc_id) using (doc_id) group by page_id),
parts as (select host, string_split(regexp_replace(host, ':\d*$', ''), '.') p from (select distinct host from seen)),
two as (select host, p, length(p[-1]) = 2 and coalesce(p[-2], '') in ({{second}}) two from parts),
named as (select host, array_to_string(case when two then p[-3:] else p[-2:] end, '.') domain, array_to_string(case when two then p[-2:] else p[-1:] end, '.') suffix from two),
hosts as (select host, domain, suffix, count(*)::double n, sum(bad)::double k from seen join known using (page_id) join named using (host) where host <> '' group by all),
o as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) rate, sum(n) n, sum(k) k from hosts),
sfx as (select suffix, sum(h.n) n, sum(h.k) k, (any_value(o.k) - sum(h.k) + any_value(rate)) / (any_value(o.n) - sum(h.n) + 1) prior from hosts h, o group by suffix),
dom as (select domain, suffix, d.n, d.k, (sfx.k - d.k + sfx.prior) / (sfx.n - d.n + 1) prior from (select domain, suffix, sum(n) n, sum(k) k from hosts group by all) d join sfx using (suffix)),
hst as (select h.n, h.k, (d.k - h.k + d.prior) / (d.n - h.n + 1) prior from hosts h join dom d using (domain)),
st as (select {STRENGTH.format("hst")} sh, {STRENGTH.format("dom")} sd, {STRENGTH.format("sfx")} ss),
hw as (select host, domain, suffix, n, k, n * (sh + 1) / (n + sh) ne, k * (sh + 1) / (n + sh) ke from hosts, st),
dw as (select domain, suffix, n, k, n * (sd + 1) / (n + sd) ne, k * (sd + 1) / (n + sd) ke from (select domain, suffix, sum(ne) n, sum(ke) k from hw group by all), st),
sw as (select suffix, sum(ne) n, sum(ke) k from dw group by suffix),
dp as (select domain, dw.n, dw.k, (sw.k - dw.ke + ss * rate) / (sw.n - dw.ne + ss) above from dw join sw using (suffix), st, o),
own as (select host, hw.k + sh * p a, hw.n - hw.k + sh * (1 - p) b from (select hw.*, (dp.k - ke + sd * above) / (dp.n - ne + sd) p from hw join dp using (domain), st) hw, st),
up as (select domain, sh * m a, sh * (1 - m) b from (select domain, (k + sd * above) / (n + sd) m from dp, st), st),
top as (select suffix, sd * m a, sd * (1 - m) b from (select suffix, (sw.k + ss * rate) / (sw.n + ss) m from sw, st, o), st),
rated as (select host, coalesce(own.a, up.a, top.a, ss * rate) a, coalesce(own.b, up.b, top.b, ss * (1 - rate)) b from named left join own using (host) left join up using (domain) left join top using (suffix), st, o where host <> ''),
bounds as (select host, a / (a + b) - 1.645 * sqrt(a * b / (a + b) ** 2 / (a + b + 1)) bound from rated),
ruled as (select *, case {{cases}} end rule from seen)
select page_id, host, path, rule, case {{verdicts}} when bound > 0.5 then 'block' else 'allow' end verdict from ruled left join bounds using (host)"""


def url_filters(rules: list[tuple[str, str, str]], second_level: list[str]) -> str:
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    cases = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for _, h, p in longest_first)
    verdicts = " ".join(f"when rule = '{h}{p}' then '{v}'" for v, h, p in rules)
    return URL_FILTERS.format(cases=cases, verdicts=verdicts, second=", ".join(f"'{x}'" for x in second_level))


# The same links as those of the join, but from 85 on; the first of a component stays.
MINHASH = f"with found as ({NGRAM_JACCARD.replace('>= 75 *', '>= 85 *')}) select *, doc_id = component_id as kept from found"

# The crc32 of an ASCII text, bit by bit: a number of 0 or more is xored in, -1 is a step of one bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, o: case when o >= 0 then xor(x, o) when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end), 4294967295::bigint)"

# Prefixes as texts of digests; a node's subtree is found on the paths of the owners of all nodes.
PREFIX_TRIE = rf"""
with turns as (select conv_id c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 pos from conversations where conv_id is not null),
marked as (select c, pos, sha256(role || chr(10) || text) mark, len({WORDS.format('text')}) words from turns),
convs as (select c, c - c % 20 base, {CRC32.format('c::varchar')} % 4 h from (select distinct c from turns)),
parts as (select k.c, 0 part, pos, mark, words from convs k join marked m on m.c = k.base where pos < h union all select k.c, 1, pos, mark, words from convs k join marked m on m.c = k.c where pos >= h),
paths as (select k.c, coalesce(list(mark order by part, pos) filter (mark is not null), []) marks, coalesce(list(words order by part, pos) filter (mark is not null), []) ws from convs k left join parts p on p.c = k.c group by k.c),
prefixes as (select c, len(marks) length, d, array_to_string(marks[:d], ',') p, array_to_string(marks[:d - 1], ',') up, case when d = 0 then 0 else ws[d] end words from paths, lateral (select unnest(range(0, len(marks) + 1)) d)),
nodes as (select d, p, any_value(up) up, min(c) owner, count(*) n, any_value(words) words from prefixes group by d, p),
kids as (select d - 1 d, up p, count(*) kids from nodes where d > 0 group by all),
every as (select n.*, coalesce(kids, 0) kids, m.owner parent from nodes n left join kids k on k.d = n.d and k.p = n.p left join nodes m on m.d = n.d - 1 and m.p = n.up),
below as (select x.d, x.p, sum((e.kids = 0)::int) leaves, sum((e.n - 1) * e.words) saved from every e join prefixes x on x.c = e.owner and x.d <= e.d group by x.d, x.p),
ends as (select d, p, sha256(string_agg(c::varchar, ',' order by c)) h from prefixes where d = length group by d, p)
select owner::bigint conv_id, e.d::bigint depth, parent::bigint parent_conv_id, n::bigint n_convs, kids::bigint n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, coalesce(h, sha256('')) ends_sha256
from every e join below b on b.d = e.d and b.p = e.p left join ends on ends.d = e.d and ends.p = e.p"""
