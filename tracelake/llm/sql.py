"""DuckDB SQL of the queries that SQL can express."""

#: The six blanks of word and strip rules, as a DuckDB expression.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {}


def dedup_lines(documents: str, min_chars: int = 20, min_docs: int = 3) -> str:
    """(doc_id, n_lines, n_dropped, text) of a relation with unique doc_ids."""
    return f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {documents}),
    line AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
    keyed AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM line),
    frequent AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= {min_chars}
                 GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
    judged AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id"""


ORACLE["op5_line_dedup"] = f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({dedup_lines('documents')})"


def mix_plan(documents: str, cap: int = 3, seed: int = 0) -> str:
    """Rows of a relation with size, source_size, target and copies. The first source that its cap does not bind sets the level."""
    return f"""
    WITH sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM {documents}),
    sums AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM sums),
    filled AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights,
                      coalesce(sum({cap} * source_size) OVER before, 0) AS used, coalesce(sum(weight) OVER before, 0) AS past
               FROM weighed WINDOW before AS (ORDER BY source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    raised AS (SELECT *, CAST(total - used AS DOUBLE) / CAST(all_weights - past AS DOUBLE) AS lam FROM filled),
    level AS (SELECT arg_min(lam, past) AS lam FROM raised WHERE {cap} * source_size >= lam * weight),
    targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST({cap} * source_size AS DOUBLE), lam * weight) AS target
                FROM weighed, level),
    rated AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
              FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT *, CAST(floor(rate) AS BIGINT) + CAST(CAST(CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|'
             || coalesce(source, 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) AS BIGINT) AS copies FROM rated"""


ORACLE["op8_source_mix"] = (
    f"SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM ({mix_plan('documents')})"
)


def measures(documents: str) -> str:
    """Rows of a relation with unique doc_ids and the six measures."""
    return f"""
    SELECT d.*, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_text_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
           coalesce(r.n_repeat_words, 0) AS n_repeat_words
    FROM (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM {documents}) d
    LEFT JOIN (
      WITH word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
                    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {documents})),
      win AS (SELECT doc_id, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
      twice AS (SELECT doc_id, pos FROM win WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1)
      SELECT doc_id, count(DISTINCT pos + i) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) s(i) GROUP BY doc_id
    ) r ON d.doc_id = r.doc_id"""


#: Value and cutoffs of each rule, from the most lenient to the strictest.
RULES = {
    "n_symbols::DOUBLE / greatest(n_words, 1)": [3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "n_dup_lines::DOUBLE / greatest(n_text_lines, 1)": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "n_repeat_words::DOUBLE / greatest(n_words, 1)": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "word_chars::DOUBLE / greatest(n_words, 1)": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0],
}


def judged(documents: str, labels: str, risk: float = 0.02, level: float = 0.05) -> str:
    """Rows with measures, base_failed and kept. Settings are rows of a cutoff per rule; the binomial tail is summed from closed-form terms."""
    n_rules, cutoffs = len(RULES), list(RULES.values())
    settings = []  # (family, place, cutoff of each rule), null where the rule rejects nothing yet
    for family in range(n_rules):
        now: list[float | None] = [None] * n_rules
        settings.append((family, -1, *now))  # rejects nothing
        place = 0
        for rule in [family, *[r for r in range(n_rules) if r != family]]:
            for c in cutoffs[rule]:
                now[rule] = c
                settings.append((family, place, *now))
                place += 1
    listed = ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else str(x) for x in s) + ")" for s in settings)
    names = ", ".join(f"c{i}" for i in range(n_rules))
    values = ", ".join(f"{v} AS v{i}" for i, v in enumerate(RULES))
    above = " OR ".join(f"coalesce(v{i} > c{i}, false)" for i in range(n_rules))
    return f"""
    WITH m AS (SELECT *, {values}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM ({measures(documents)})),
    known AS (SELECT doc_id, min(quality) AS quality FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    held AS (SELECT lang, coalesce(text, '') AS body, min(quality) = 1 AS good, {", ".join(f"any_value(v{i}) AS v{i}" for i in range(n_rules))}
             FROM m JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY lang, body),
    setting(family, place, {names}) AS (VALUES {listed}),
    counted AS (SELECT lang, family, place, count(*) FILTER (good) AS n, count(*) FILTER (good AND ({above})) AS k, count(*) FILTER (NOT good AND ({above})) AS bad
                FROM held, setting GROUP BY ALL HAVING count(*) FILTER (good) > 0),
    strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT coalesce(lang, ''), lang IS NULL FROM counted)),
    tested AS (SELECT *, place < 0 OR k < n * {risk} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                 + j * ln({risk}) + (n - j) * ln(1 - {risk})))) <= {level} / ((SELECT n FROM strata) * {n_rules}) AS safe FROM counted),
    passed AS (SELECT * FROM (SELECT *, bool_and(safe) OVER (PARTITION BY lang, family ORDER BY place) AS up FROM tested) WHERE up
               QUALIFY row_number() OVER (PARTITION BY lang, family ORDER BY place DESC) = 1),
    taken AS (SELECT lang, family, place FROM passed QUALIFY row_number() OVER (PARTITION BY lang ORDER BY bad DESC, family) = 1),
    cut AS (SELECT t.lang, s.* EXCLUDE (family, place) FROM taken t JOIN setting s ON s.family = t.family AND s.place = t.place)
    SELECT m.*, NOT base_failed AND NOT ({above}) AS kept FROM m LEFT JOIN cut ON m.lang IS NOT DISTINCT FROM cut.lang"""


ORACLE["op6_quality_rules"] = (
    "SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept "
    f"FROM ({judged('documents', 'labels')})"
)

ORACLE["op7_chat_snapshots"] = """
    WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t),
    p AS (SELECT conv_id, place, list([role, text]) OVER (PARTITION BY conv_id ORDER BY place) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM r),
    whole AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, prefix FROM p WHERE place = n_turns GROUP BY n_turns, prefix),
    kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place = w.n_turns AND p.n_turns > p.place AND p.prefix = w.prefix))
    SELECT k.conv_id, (r.place - 1) // 1024 AS part, k.n_turns, k.n_copies,
           string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
    FROM kept k JOIN r ON r.conv_id = k.conv_id GROUP BY ALL"""


def fill_in_middle(documents: str, seed: str = "7", percent: int = 100, spm_percent: int = 50) -> str:
    """(doc_id, n, form, prefix_chars, middle_chars, output, text) of a relation."""
    word = lambda i: f"CAST(concat('0x', substr(hex, {8 * i + 1}, 8)) AS BIGINT)"
    upto = lambda k: f"CASE WHEN {k} = 0 THEN '' WHEN {k} = n THEN text ELSE array_to_string(list_slice(parts, 1, {k}), chr(10)) || chr(10) END"
    return f"""
    WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
                          sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM {documents}),
    counted AS (SELECT *, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n,
                       {", ".join(f"{word(i)} AS h{i + 1}" for i in range(4))} FROM split),
    cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {percent} THEN 'plain'
                        WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM counted),
    ended AS (SELECT *, length({upto("a")}) AS p, length({upto("b")}) AS q FROM cut),
    parted AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM ended)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
           CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                     ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output, text
    FROM parted"""


ORACLE["op11_fill_in_middle"] = f"""
    SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
    FROM ({fill_in_middle('documents')})"""


def whole_vectors(embeddings: str, scale: int) -> str:
    """Rows of a relation that take part, components as whole numbers."""
    return f"""SELECT row_number() OVER () AS row_id, vec_id, label, [floor({scale}.0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM {embeddings}
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""


ORACLE["op12_exact_top_k"] = f"""
    WITH whole AS ({whole_vectors('embeddings', 1024)}),
    scored AS (SELECT q.row_id, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
               FROM whole q JOIN whole x ON q.vec_id % 100 = 0 AND q.row_id <> x.row_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

ORACLE["op13_hard_negatives"] = f"""
    WITH whole AS (SELECT row_id, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
                   FROM ({whole_vectors('embeddings', 256)}) WHERE label IS NOT NULL),
    scored AS (SELECT a.row_id AS anchor, a.vec_id AS anchor_id, x.row_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
               FROM whole a JOIN whole x ON a.vec_id % 100 = 0 AND a.row_id <> x.row_id),
    positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5),
    window_rows AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                           CAST(row_number() OVER (PARTITION BY p.anchor, p.row_id ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INT) AS rank
                    FROM positive p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM window_rows WHERE rank <= 5"""
