"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from dealspan.llm import collocations, decontam, linededup, phrases, urlfilter


def url_filter(order: int = urlfilter.ORDER, weight: float = urlfilter.WEIGHT) -> str:
    """Rules, then models of variable order by one subquery per order, then the calibrated threshold."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.name}')" for r in urlfilter.RULES)
    held = ", ".join(f"'{c}'" for c in urlfilter.HELD_OUT)
    parts = [f"""
      rules(v, h, p, name) as (values {rules}),
      parsed as (select page_id, url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
      hosts as (select distinct host, path from parsed),
      ruled as (select host, path, arg_max(name, length(name)) as rule, arg_max(v, length(name)) as v
        from hosts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path),
      judged as (select page_id, url, host, path, rule, v from parsed left join ruled using (host, path)),
      urls as (select distinct url, v, substr(md5(url), 1, 1) not in ({held}) as learns from judged where url is not null),
      places as (select url, v, learns, unnest(range(1, length(url) + 2)) as i,
        repeat(chr(2), {order}) || translate(url, '{upper}', '{lower}') || chr(3) as padded from urls),
      grams as (select url, v, learns, substr(padded, i, {order + 1}) as gram from places),
      counts as (select gram, count(*) filter (learns and v = 'allow') as a, count(*) filter (learns and v = 'block') as b
        from grams group by gram),
      letters as (select count(distinct substr(gram, {order + 1}, 1)) + 1 as n from counts)"""]
    for n in range(order + 1):
        base = "(select 1.0::double / n from letters)"
        pa, pb = ("s.pa", "s.pb") if n else (base, base)
        join = f"join m{n - 1} s on s.context = substr(c.context, 2) and s.letter = c.letter" if n else ""
        parts.append(f"""
      c{n} as (select substr(gram, {order + 1 - n}, {n}) as context, substr(gram, {order + 1}, 1) as letter, sum(a) as a, sum(b) as b
        from counts group by all),
      t{n} as (select context, sum(a) as a, sum(b) as b from c{n} group by context),
      m{n} as (select c.context, c.letter, (c.a + {weight} * {pa}) / (t.a + {weight}) as pa, (c.b + {weight} * {pb}) / (t.b + {weight}) as pb
        from c{n} c join t{n} t on t.context = c.context {join})""")
    return f"""with {",".join(parts)},
      scored as (select url, any_value(v) as v, any_value(learns) as learns, sum(ln(pa) - ln(pb)) / (length(url) + 1) as score
        from grams join m{order} on context || letter = gram group by url),
      sides as (select avg(score) filter (v = 'allow') as ma, avg(score) filter (v = 'block') as mb,
        coalesce(stddev_pop(score) filter (v = 'allow'), 0) as sa, coalesce(stddev_pop(score) filter (v = 'block'), 0) as sb
        from scored where not learns and v is not null),
      learned as (select count(distinct v) as n from scored where learns and v is not null),
      cut as (select case when n < 2 or ma is null or mb is null then -1e308
        when sa + sb > 0 then (ma * sb + mb * sa) / (sa + sb) else (ma + mb) / 2 end as t from sides, learned)
      select page_id, host, path, rule,
        coalesce(v, case when score is null or score >= (select t from cut) then 'allow' else 'block' end) as verdict
      from judged left join (select url, score from scored) using (url)"""


def substring_dedup(window: int = phrases.WINDOW) -> str:
    return rf"""with texts as (select doc_id, row_number() over () as r,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') as w from documents),
      starts as (select r, unnest(range(1, len(w) - {window} + 2)) as i, w from texts where len(w) >= {window}),
      keys as (select r, i, array_to_string(w[i : i + {window} - 1], ' ') as k from starts),
      again as (select k from keys group by k having count(*) > 1),
      gone as (select distinct r, unnest(range(i, i + {window})) as i from keys join again using (k)),
      lists as (select r, list(i) as g from gone group by r),
      kept as (select doc_id, w, coalesce(g, []) as g from texts left join lists using (r))
      select doc_id, len(w) as n_words, len(g) as n_removed,
        sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(g, i)), ' ')) as kept_sha256 from kept"""


def line_dedup(width: int = linededup.WIDTH) -> str:
    return rf"""with texts as (select doc_id, text, string_split(text, chr(10)) as l from documents),
      starts as (select doc_id, l, unnest(range(1, len(l) - {width} + 2)) as i from texts where len(l) >= {width}),
      keys as (select doc_id, i, array_to_string(l[i : i + {width} - 1], chr(10)) as k from starts),
      windows as (select * from keys where regexp_matches(k, '[^ \t\r\n]')),
      firsts as (select k, min((doc_id, i)) as f from windows group by k having count(*) > 1),
      later as (select doc_id, case when f[1] = doc_id then greatest(i, f[2] + {width}) else i end as b, i + {width} as e
        from windows join firsts using (k) where (doc_id, i) <> f),
      gone as (select distinct doc_id, unnest(range(b, e)) as i from later where b < e),
      lists as (select doc_id, list(i) as g from gone group by doc_id)
      select doc_id, coalesce(len(l), 0)::int as n_lines, coalesce(len(g), 0)::int as n_removed,
        case when g is null then text else array_to_string(list_filter(l, lambda x, i: not list_contains(g, i)), chr(10)) end as text
      from texts left join lists using (doc_id)"""


def decontamination(n: int = decontam.SHINGLE, contained: float = decontam.CONTAINED) -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '')"
    runs = "array_to_string(w[i : i + m - 1], ' ') as s"
    return f"""with d as (select doc_id, {words} as w from documents), b as (select item_id, {words} as w from benchmark),
      lengths as (select {n} as m union select len(w) from b where len(w) between 1 and {n - 1}),
      ds as (select distinct doc_id, {runs} from (select doc_id, m, unnest(range(1, len(w) - m + 2)) as i, w from d, lengths where len(w) >= m)),
      bs as (select distinct item_id, {runs} from (select item_id, m, unnest(range(1, len(w) - m + 2)) as i, w
        from (select item_id, w, least({n}, len(w)) as m from b where len(w) > 0))),
      sizes as (select item_id, count(*) as n_item from bs group by item_id),
      shared as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by all)
      select doc_id, item_id, n_shared, n_item, n_shared / n_item as share from shared join sizes using (item_id)
      where n_shared >= ceil(n_item * {contained}::double - 1e-9)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prefix_targets() -> str:
    """All from the turns themselves, so that equal rows prove that formatting loses nothing."""
    escaped = r"regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"
    return f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from
          (select conv_id, turn, role, text from conversations union all
           values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
      p as (select *, role = 'assistant' as reply, length({escaped}) + case when role = 'assistant' then 4 else 14 + length(role) end as chars from t),
      w as (select *, 3 + sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto,
        row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as ends from p)
      select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (reply), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (reply), '')) as loss_sha256,
        sum(upto) filter (reply or ends)::bigint as formatted_chars
      from w group by conv_id"""


def document_ranking(k: int = 10) -> str:
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with d as (select row_number() over () as r, doc_id, {terms} as t from documents),
      own as (select r, doc_id, len(t) as n from d where len(t) > 0),
      total as (select count(*) as docs, sum(n)::bigint as terms from own),
      sizes as (select r, doc_id, 100 - 90 + (90 * n * docs) // terms as m from own, total),
      tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) group by all),
      weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by term, docs),
      asked as (select distinct item_id, unnest({terms}) as term from benchmark),
      scored as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
        from asked join weights using (term) join tf using (term) join sizes using (r) group by item_id, r, doc_id),
      ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
        from scored where score > 0)
      select * from ranked where rank <= {k}"""


def phrase_collocations(least: int = collocations.LEAST, top: int = collocations.TOP, covered: int = collocations.COVERED) -> str:
    return rf"""with pieces as (select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as p from documents),
      words as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
      places as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
      grams as (select lang, k, w[i : i + k - 1] as g, count(*) as f
        from places, (values (1), (2), (3)) as sizes(k) where i + k - 1 <= len(w) group by all),
      total as (select lang, sum(f)::bigint as n from grams where k = 1 group by lang),
      wanted as (select lang, g, f as a, unnest(range(1, k)) as c from grams where k > 1 and f >= {least}),
      cuts as (select w.lang, w.g, w.a, w.c, x.f as l, y.f as r,
          ((1000000::hugeint * w.a * w.a) // (x.f::hugeint * y.f))::bigint as score
        from wanted w join grams x on x.lang = w.lang and x.g = w.g[: w.c] join grams y on y.lang = w.lang and y.g = w.g[w.c + 1 :]),
      weakest as (select * from cuts qualify row_number() over (partition by lang, g order by score, c) = 1),
      parts as (select lang, g[1:2] as g, a from weakest where len(g) = 3 union all select lang, g[2:3], a from weakest where len(g) = 3),
      longer as (select lang, g, max(a) as b from parts group by all),
      phrases as (select w.lang, array_to_string(w.g, ' ') as phrase, w.a, l, r, score from weakest w left join longer using (lang, g)
        where b is null or 100 * b < {covered} * w.a),
      ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase)::int as rank from phrases)
      select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= {top}"""


def checks() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter(),
        "op7_substring_dedup": substring_dedup(),
        "op8_line_dedup": line_dedup(),
        "op9_decontamination": decontamination(),
        "op11_prefix_targets": prefix_targets(),
        "op12_document_fptree": document_ranking(),
        "op13_phrase_collocations": phrase_collocations(),
    }
