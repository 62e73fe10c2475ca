"""SQL for the queries whose results it can express, run on whole tables."""

from __future__ import annotations

_ESCAPED = r"""regexp_replace({}, '(\\|###|</turn>)', '\\\1', 'g')"""

OP9 = rf"""
    with turns as (
        select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
        union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    made as (select *, length('### ' || replace(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g'), chr(10), '\n') || ':' || chr(10) || {_ESCAPED.format("text")} || '</turn>' || chr(10)) n from turns)
    select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
           coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256, sum(n)::bigint formatted_chars
    from made group by conv_id"""

OP3 = """
    with recursive words as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w from documents),
    sets as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) s from words where len(w) > 0),
    folded as (select min(doc_id) rep, s, len(s) n from (select doc_id, list_sort(s) s from sets) group by s),
    each as (select rep, n, unnest(s) x from folded),
    pairs as (select a.rep a, b.rep b, any_value(a.n) an, any_value(b.n) bn, count(*) k from each a join each b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
    links as (select a, b from pairs where 100 * k >= 80 * (an + bn - k)),
    ways as (select a, b from links union select b, a from links),
    reach(id, found) as (select rep, rep from folded union select id, b from reach join ways on found = a),
    lowest as (select id, min(found) c from reach group by 1),
    classes as (select s.doc_id, len(s.s) n, f.rep from (select doc_id, list_sort(s) s from sets) s join folded f on f.s = s.s)
    select d.doc_id, coalesce(c.n, 0)::bigint n_shingles, coalesce(l.c, d.doc_id) component_id, coalesce(l.c, d.doc_id) = d.doc_id kept from documents d left join classes c using (doc_id) left join lowest l on l.id = c.rep"""

ORACLE_SQL = {"op3_minhash_circulant": OP3, "op9_chat_template": OP9}
