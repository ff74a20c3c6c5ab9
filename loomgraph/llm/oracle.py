"""SQL, as DuckDB runs it, for the queries of this subpackage that SQL can express."""

#: Fixed: a word, and the letters that the Jaccard join lower-cases.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of shingles, pairs that share any, and what each document's links lead to.
NGRAM_JACCARD = f"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{WORD}') w from documents),
s as (select distinct doc_id, x from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) x from w)),
n as (select doc_id, count(*) n from s group by 1),
both_in as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (x) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from both_in join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
adj as (select a, b from l union all select b, a from l),
reach as (select doc_id a, doc_id b from documents union select r.a, adj.b from reach r join adj on adj.a = r.b)
select a doc_id, coalesce(any_value(n), 0)::bigint n_shingles, min(b) component_id from reach left join n on n.doc_id = a group by a"""

#: Windows numbered by their words; all but the first of equals take their words away.
SUBSTRING_DEDUP = f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
wins as (select doc_id, i, array_to_string(w[i:i + 19], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 18)) i from w where len(w) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) r from wins) where r > 1),
words as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) x from w),
marked as (select doc_id, i, x, max(l.i) over (partition by doc_id order by words.i rows between 19 preceding and current row) is not null gone
  from words left join later l using (doc_id, i)),
kept as (select doc_id, count(*) filter (where gone) n_removed, string_agg(x, ' ' order by i) filter (where not gone) kept from marked group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join kept using (doc_id)"""

#: Sources fill up in the order of cap over weight; the rest share one level.
MIXING_TARGETS = f"""with s as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}')))::bigint n from documents group by 1),
w as (select source, n, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight from s),
f as (select *, sum(n) over () - coalesce(sum(3 * n) over before, 0) rest, sum(weight) over () - coalesce(sum(weight) over before, 0) left_weight
  from w window before as (order by 3 * n / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select min_by(rest / left_weight, 3 * n / weight) t from f where rest / left_weight * weight <= 3 * n)
select source, n source_size, round(least(3 * n, coalesce(t * weight, 3 * n)), 6)::double target from f, level"""


def _spans(kind: int, name: str, pattern: str, holds: str) -> str:
    """doc_id, kind, name, start, end of the matches that hold: a match starts behind the pieces and matches before it."""
    return f"""select doc_id, {kind} kind, '{name}' "name", s, s + length(f) e from (
  select doc_id, f, sum(length(piece)) over (partition by doc_id order by k) + coalesce(sum(length(f)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) s,
    regexp_replace(f, '[^0-9]', '', 'g') d
  from (select doc_id, unnest(m) f, unnest(p[:len(m)]) piece, unnest(range(len(m))) k from (
    select doc_id, regexp_extract_all(t, '{pattern}') m, regexp_split_to_array(t, '{pattern}') p from t))) where {holds}"""


_LUHN = "list_sum(list_transform(range(length(d)), lambda i: case when i % 2 = 0 then d[length(d) - i]::int else (d[length(d) - i]::int * 2) // 10 + (d[length(d) - i]::int * 2) % 10 end)) % 10 = 0"
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(f, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(right(x, 3) as int), 0) <= 255))"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"case when length(d) between 16 and 19 then {_LUHN} else false end"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 8 and 15"),
)
#: The four patterns with their checks.
PERSONAL_BASE = (
    "with t as (select doc_id, coalesce(text, '') t from documents), spans as ("
    + " union all ".join(_spans(i, *k) for i, k in enumerate(_KINDS))
    + """), told as (select doc_id, string_agg("name" || ':' || s || ':' || e, ',' order by kind, s) base, """
    + ", ".join(f"count(*) filter (where kind = {i}) n_{k[0]}" for i, k in enumerate(_KINDS))
    + " from spans group by 1) select doc_id, "
    + ", ".join(f"coalesce(n_{k[0]}, 0)::bigint n_{k[0]}" for k in _KINDS)
    + ", sha256(coalesce(base, '')) base_sha256 from t left join told using (doc_id)"
)

#: Bytewise, by the table of the polynomial; an argument in decimal.
_CRC = """crc_table as (select list(v order by i) t from (select i, list_reduce(list_concat([i], range(8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end) v from (select unnest(range(256)) i))),
crc as (select id, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(id::varchar) + 1), lambda i: ord((id::varchar)[i])::bigint)),
  lambda v, b: xor(v // 256, t[xor(v, b) % 256 + 1])), 4294967295) c from (select distinct {id} id from {of}), crc_table)"""


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _told(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _tree(name: str, leaves: str) -> str:
    """The levels of trees over leaves (tree, i, n, h), and what stands before and after each node in its run."""
    return f"""{name} as (select 0 lv, tree, i, n, h from {leaves}
  union all select lv + 1, tree, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by lv, tree, i // 8, n),
{name}_beside as (select lv, tree, i, n, h, coalesce(string_agg(h, '' order by i) over (run rows between unbounded preceding and 1 preceding), '') before,
  coalesce(string_agg(h, '' order by i) over (run rows between 1 following and unbounded following), '') after from {name} where n > 1 window run as (partition by lv, tree, i // 8 order by i)),
{name}_root as (select tree, h from {name} where n = 1)"""


#: Trees of languages and the tree of their roots, proofs by level, and a walk up from what each leaf now is.
MERKLE_MANIFEST = f"""with recursive {_CRC.format(id="doc_id", of="documents")},
d as (select doc_id, coalesce('=' || lang, '') tree, sha256({" || ".join(_told(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) leaf,
  sha256({" || ".join(_told(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_told(_lower("text"))}) lowered from documents),
l as (select *, row_number() over (partition by tree order by doc_id) - 1 i, count(*) over (partition by tree) n from (select doc_id, tree, leaf h, lowered from d)),
{_tree("low", "l")},
s as (select '' tree, row_number() over (order by tree) - 1 i, count(*) over () n, h, tree subtree from low_root),
{_tree("top", "s")},
now as (select doc_id, tree, i, case when c % 3 = 0 then lowered else h end h from l join crc on id = doc_id),
up as (select 0 lv, doc_id, tree, i, h, '' proof from now
  union all select up.lv + 1, doc_id, up.tree, up.i // 8, sha256(before || up.h || after), proof || before || after from up join low_beside b on b.lv = up.lv and b.tree = up.tree and b.i = up.i),
ends as (select doc_id, tree, max_by(h, lv) h, max_by(proof, lv) proof from up group by 1, 2),
over as (select 0 lv, doc_id, s.i, ends.h, proof from ends join s on s.subtree = ends.tree
  union all select o.lv + 1, doc_id, o.i // 8, sha256(before || o.h || after), proof || before || after from over o join top_beside b on b.lv = o.lv and b.i = o.i)
select doc_id, l.h leaf, low_root.h subroot, top_root.h root, sha256(max_by(proof, lv)) proof_sha256, max_by(over.h, lv) folded_root, max_by(over.h, lv) = top_root.h verified
from over join l using (doc_id) join low_root on low_root.tree = l.tree, top_root group by doc_id, l.h, low_root.h, top_root.h"""

#: Lines by key, and the keys of many documents.
LINE_DEDUP = f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
x as (select doc_id, unnest(l) line, unnest(range(len(l))) i from d),
k as (select *, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} key from x),
shared as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) n_lines, count(shared.key) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where shared.key is null), '')) kept_sha256
from k left join shared using (key) group by doc_id"""

#: Every prefix of every conversation as a list of turns; a prefix belongs to the subtrees of its own prefixes.
PREFIX_TRIE = f"""with recursive {_CRC.format(id="conv_id", of="conversations")},
t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i from conversations),
h as (select id conv_id, c % 4 h from crc),
made as (select h.conv_id, 0 part, t.i, r, x from h join t on t.conv_id = h.conv_id - h.conv_id % 20 and t.i <= h.h union all select h.conv_id, 1, t.i, r, x from h join t on t.conv_id = h.conv_id and t.i > h.h),
whole as (select h.conv_id, coalesce(list(struct_pack(r := r, x := x) order by part, i) filter (where i is not null), []) l from h left join made using (conv_id) group by 1),
prefixes as (select conv_id, d, l[1:d] p, len(l) n from (select conv_id, l, unnest(range(len(l) + 1)) d from whole)),
nodes as (select d, p, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '') ends,
  case when d = 0 then 0 else len(regexp_extract_all(p[-1].x, '{WORD}')) end words from prefixes group by d, p),
named as (select prefixes.conv_id member, prefixes.d, nodes.conv_id from prefixes join nodes using (d, p)),
up as (select c.d, c.conv_id, named.conv_id parent from nodes c join named on named.member = c.conv_id and named.d = c.d - 1),
kids as (select d - 1 d, parent conv_id, count(*) k from up group by all),
under as (select named.d, named.conv_id, sum((b.n_convs - 1) * b.words) saved, count(*) filter (where kids.k is null) leaves
  from nodes b left join kids on kids.d = b.d and kids.conv_id = b.conv_id join named on named.member = b.conv_id and named.d <= b.d group by 1, 2)
select nodes.conv_id, nodes.d "depth", up.parent parent_conv_id, n_convs, coalesce(k, 0)::bigint n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(ends) ends_sha256
from nodes join under using (d, conv_id) left join up using (d, conv_id) left join kids using (d, conv_id)"""

SQL = {"op1_ngram_jaccard": NGRAM_JACCARD, "op4_substring_dedup": SUBSTRING_DEDUP, "mixing_targets": MIXING_TARGETS, "personal_base": PERSONAL_BASE, "op11_merkle_manifest": MERKLE_MANIFEST, "op12_line_dedup": LINE_DEDUP, "op13_prefix_trie": PREFIX_TRIE}
