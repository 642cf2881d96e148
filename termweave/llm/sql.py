"""SQL for another engine than Spark that gives the rows of the text queries it can express."""

from __future__ import annotations

from termweave.llm import op9_quality

WORD = r"[^\x20\x09-\x0D]+"

LINES = rf"""
    WITH d AS (SELECT doc_id, text, coalesce('=' || source, '') AS site, string_split(text, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, site, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
    shared AS (SELECT line FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY line HAVING count(DISTINCT site) >= 10),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM l
             WHERE line NOT IN (SELECT line FROM shared) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines,
           (coalesce(len(lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

SUBSTRINGS = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS key
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    first AS (SELECT key, min(doc_id) AS doc_id FROM windows GROUP BY key),
    gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.i, w.i + 13)) AS i
             FROM windows w JOIN first f ON f.key = w.key AND f.doc_id < w.doc_id),
    words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
    placed AS (SELECT w.*, g.i IS NOT NULL AS gone FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i),
    edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM placed),
    found AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(begins) AS n_spans,
                     string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
           coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN found f ON f.doc_id = d.doc_id"""

MIX = rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                      (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
                      / 4503599627370496.0::DOUBLE AS u FROM documents),
    s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    s2 AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight,
                  3 * source_size AS most FROM s1),
    s3 AS (SELECT *, coalesce(sum(most) OVER before, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER before, 0)::DOUBLE AS gone,
                  (sum(source_size) OVER ())::DOUBLE AS all_size, (sum(weight) OVER ())::DOUBLE AS all_weight FROM s2
           WINDOW before AS (ORDER BY most::DOUBLE / weight::DOUBLE, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s4 AS (SELECT *, (all_size - capped) / (all_weight - gone) AS level FROM s3),
    s5 AS (SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level * weight <= most THEN 0 ELSE 1 END, gone) AS shared FROM s4),
    s6 AS (SELECT source, source_size, least(most::DOUBLE, shared * weight) AS target FROM s5),
    s7 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM s6),
    s8 AS (SELECT *, greatest(target - copies * source_size, 0.0::DOUBLE) AS wanted FROM s7),
    g1 AS (SELECT d.source, size, count(*) AS n, any_value(wanted) AS wanted FROM d
           JOIN s8 ON s8.source IS NOT DISTINCT FROM d.source WHERE size > 0 GROUP BY d.source, size),
    g2 AS (SELECT source, size, (wanted - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                  / (sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC
                                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS slope FROM g1),
    slopes AS (SELECT source, max_by(slope, size) AS slope FROM g2 WHERE slope * size <= 1 GROUP BY source),
    r1 AS (SELECT d.*, source_size, target, copies, wanted, least(1.0::DOUBLE, coalesce(slope, 0.0::DOUBLE) * size) AS p FROM d
           JOIN s8 ON s8.source IS NOT DISTINCT FROM d.source
           LEFT JOIN slopes ON slopes.source IS NOT DISTINCT FROM d.source),
    r2 AS (SELECT *, (u * (1.0::DOUBLE - p)) / (u * (1.0::DOUBLE - p) + p * (1.0::DOUBLE - u)) AS t FROM r1),
    r3 AS (SELECT doc_id, 2 * sum(size) OVER (PARTITION BY source ORDER BY t, doc_id) - size <= 2 * wanted AS drawn
           FROM r2 WHERE size > 0 AND wanted > 0)
    SELECT r2.doc_id, size, source_size, target, ((copies + coalesce(drawn, false)::BIGINT) * size)::BIGINT AS taken,
           (copies + coalesce(drawn, false)::BIGINT)::BIGINT AS copies
    FROM r2 LEFT JOIN r3 ON r3.doc_id = r2.doc_id"""

_SCALED = """[{'measure': 'word_length', 'v': word_chars * 100 // greatest(n_words, 1)},
              {'measure': 'symbols', 'v': n_symbols * 1000 // greatest(n_words, 1)},
              {'measure': 'dup_lines', 'v': n_dup_lines * 1000 // greatest(n_lines, 1)},
              {'measure': 'repeats', 'v': n_repeat_words * 1000 // greatest(n_words, 1)}]"""


def _quantiles(name: str, keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    picks = ", ".join(f"min(CASE WHEN upto >= total * {p}::DOUBLE THEN value END) AS q{int(p * 100)}" for p in op9_quality.POINTS)
    return f"""{name} AS (SELECT {by}, any_value(total) AS total, {picks}
        FROM (SELECT *, (sum(n) OVER (PARTITION BY {by} ORDER BY value))::DOUBLE AS upto, (sum(n) OVER (PARTITION BY {by}))::DOUBLE AS total
              FROM (SELECT {by}, value, sum(n) AS n FROM sketch GROUP BY {by}, value)) GROUP BY {by})"""


_LEAST = "CASE g.measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in op9_quality.LEAST_SPREAD.items()) + " END"

QUALITY = rf"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
    t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
    r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM t WHERE times > 1) GROUP BY doc_id),
    base AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
                    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                    coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
    scaled AS (SELECT doc_id, lang, source, base_failed, unnest({_SCALED}) AS m FROM judged),
    sketch AS (SELECT lang, source, m.measure AS measure,
                      (m.v >> greatest(length(bin(m.v)) - {op9_quality.MANTISSA}, 0)) << greatest(length(bin(m.v)) - {op9_quality.MANTISSA}, 0) AS value,
                      count(*) AS n FROM scaled WHERE NOT base_failed GROUP BY ALL),
    {_quantiles('own', 'lang, source')}, {_quantiles('of_lang', 'lang')}, {_quantiles('of_all', '')},
    used AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.total >= 100 THEN [o.q10, o.q50, o.q90]
                    WHEN l.total >= 100 THEN [l.q10, l.q50, l.q90] ELSE [a.q10, a.q50, a.q90] END AS q
             FROM own o JOIN of_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
             JOIN of_all a ON a.measure = o.measure),
    limits AS (SELECT lang, source, measure, q[1] - 4.0::DOUBLE * greatest(q[2] - q[1], {_LEAST}::DOUBLE) AS low,
                      q[3] + 4.0::DOUBLE * greatest(q[3] - q[2], {_LEAST}::DOUBLE) AS high FROM used g),
    within AS (SELECT s.doc_id, bool_and(s.m.v <= high AND (s.m.measure <> 'word_length' OR s.m.v >= low)) AS ok
               FROM scaled s JOIN limits l ON l.lang IS NOT DISTINCT FROM s.lang AND l.source IS NOT DISTINCT FROM s.source
                AND l.measure = s.m.measure GROUP BY s.doc_id)
    SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(ok, false) AS kept
    FROM judged j LEFT JOIN within i ON i.doc_id = j.doc_id"""

LEXICAL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
    size AS (SELECT count_if(len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS length FROM d),
    tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
           GROUP BY ALL),
    w AS (SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * any_value(n_docs) + 2.0::DOUBLE) / (2.0::DOUBLE * count(*) + 1.0::DOUBLE)))::BIGINT AS w
          FROM tf, size GROUP BY term),
    scored AS (SELECT item_id, doc_id,
                      sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length))))::BIGINT AS score
               FROM asked JOIN tf USING (term) JOIN w USING (term), size GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
               FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 20"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))"
    step = "xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: {step}), 4294967295)"


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _levels(name: str, tree: str, levels: int) -> str:
    """CTEs of ``levels`` levels above ``name``0 (tree, place, node, of): trees of one node stay as they are."""
    parts = []
    for i in range(1, levels + 1):
        parts.append(f"""
    {name}{i} AS (SELECT {tree}, place // 3 AS place, CASE WHEN any_value(of) = 1 THEN any_value(node)
                         ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node, (any_value(of) + 2) // 3 AS of
                  FROM {name}{i - 1} GROUP BY {tree}, place // 3),""")
    return "".join(parts)


def _way(name: str, tree: str, levels: int, start: str) -> str:
    """CTEs that carry rows (tree, place, proof, fold) of ``start`` up the levels of ``name``."""
    parts, before = [], start
    for i in range(levels):
        parts.append(f"""
    {start}_{i} AS (SELECT r.* REPLACE (r.place // 3 AS place, r.proof || coalesce(s.before, '') || coalesce(s.after, '') AS proof,
                           CASE WHEN s.of = 1 THEN r.fold ELSE sha256(coalesce(s.before, '') || r.fold || coalesce(s.after, '')) END AS fold)
                    FROM {before} r JOIN (
                        SELECT a.{tree}, a.place, any_value(a.of) AS of, string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place) AS before,
                               string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place) AS after
                        FROM {name}{i} a JOIN {name}{i} b ON b.{tree} = a.{tree} AND b.place // 3 = a.place // 3 GROUP BY a.{tree}, a.place) s
                    ON s.{tree} = r.{tree} AND s.place = r.place),""")
        before = f"{start}_{i}"
    return "".join(parts)


#: Levels written out: sources of up to 3 ** 12 documents, and 3 ** 5 sources.
_IN_SOURCE, _OF_SOURCES = 12, 5

MANIFEST = f"""
    WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {_leaf('text')} AS node,
                      CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS shown
               FROM documents),
    n0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, node) - 1 AS place, count(*) OVER (PARTITION BY tree) AS of FROM d),
    {_levels('n', 'tree', _IN_SOURCE)}
    s0 AS (SELECT '' AS whole, tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS of FROM n{_IN_SOURCE}),
    {_levels('s', 'whole', _OF_SOURCES)}
    up AS (SELECT doc_id, tree, place, node AS leaf, '' AS proof, shown AS fold FROM n0),
    {_way('n', 'tree', _IN_SOURCE, 'up')}
    over AS (SELECT u.* REPLACE (s.place AS place), '' AS whole, s.node AS subroot FROM up_{_IN_SOURCE - 1} u JOIN s0 s ON s.tree = u.tree),
    {_way('s', 'whole', _OF_SOURCES, 'over')}
    root AS (SELECT node AS root FROM s{_OF_SOURCES})
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
    FROM over_{_OF_SOURCES - 1}, root"""
