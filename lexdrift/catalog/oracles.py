"""The catalogue queries as DuckDB SQL, written from the rules and not from the Spark
expressions. Texts of ``documents`` have no whitespace but space and LF, which lets the
line-break rule be stated without look-behind.

Marks, patterns and report texts in the statements are fixed values: they must equal those of the queries."""

from __future__ import annotations

from lexdrift.catalog.derived import BROKEN_BYTES, FORM_TEXT
from lexdrift.catalog.queries import LATTICE_LETTER, LATTICE_UNKNOWN, LIMIT, PREVIEW, WORD_LIMIT

WORDS_1 = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORDS_2 = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
BLANKS = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"


def _by_lang(otherwise: str, **cases: str) -> str:
    whens = " ".join(f"WHEN lang = '{lang}' THEN {value}" for lang, value in cases.items())
    return f"CASE {whens} ELSE {otherwise} END"


def _title(text: str) -> str:
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: trim(x, {BLANKS}))"
    content = (
        "x <> '' AND x <> '_START_ARTICLE_' AND NOT starts_with(x, '_START_SECTION_') "
        "AND NOT starts_with(x, '_START_PARAGRAPH_')"
    )
    return (
        f"CASE WHEN {text} <> '' THEN left(coalesce("
        f"list_filter({lines}, lambda x: {content})[1], "
        f"list_filter({lines}, lambda x: x <> '')[1], ''), 100) END"
    )


def _normalized(text: str) -> str:
    unified = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    stripped = f"trim({unified}, {BLANKS})"
    joined = (
        f"regexp_replace({stripped}, "
        r"'([。．.!?！？])[ \t\f]*(?:\n[ \t\f]*)+', '\1', 'g')"
    )
    return rf"trim(regexp_replace({joined}, '\n+[ \t\f]*', chr(10), 'g'), {BLANKS})"


def _tokens(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), []::VARCHAR[])"


def _cost(terms: str) -> str:
    return (
        f"coalesce(list_sum(list_transform({terms}, lambda t: 100 + 10 * length(t))), 0)::BIGINT"
    )


def _pos(terms: str) -> str:
    return (
        f"list_transform({terms}, lambda t: CASE "
        r"WHEN regexp_full_match(t, '\p{L}+') THEN 'word' "
        r"WHEN regexp_full_match(t, '\p{N}+') THEN 'number' "
        r"WHEN regexp_matches(t, '^[\p{L}\p{N}]') THEN 'mixed' ELSE 'symbol' END)"
    )


def _joined(items: str) -> str:
    return f"md5(coalesce(array_to_string({items}, ' '), ''))"


PAGE_TITLE = _by_lang(
    _title("text"),
    de=f"'Help:' || ({_title('text')})",
    fr=f"({_title('text')}) || ' (' || source || ') x'",
    es=f"' ' || chr(9) || ({_title('text')}) || '：' || chr(10)",
)
PAGE_TEXT = "CASE WHEN source = 'src0' THEN '' ELSE text END"
ANNOTATED = "strpos(t, ' (') > 0 AND strpos(substr(t, strpos(t, ' (')), ')') > 0"
BARE_TITLE = f"CASE WHEN {ANNOTATED} THEN substr(t, 1, strpos(t, ' (') - 1) ELSE t END"
ANNOTATION = (
    f"CASE WHEN {ANNOTATED} THEN split_part(substr(t, strpos(t, ' (') + 2), ')', 1) END"
)

def _pages_of(text: str) -> str:
    return f"""
pages_in AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, lang, source,
         trim({PAGE_TITLE}, {BLANKS}) AS t,
         {_normalized(text)} AS text
  FROM documents
), page_rows AS (
  SELECT id, doc_id, lang, {BARE_TITLE} AS title, {ANNOTATION} AS title_annotation, text
  FROM pages_in WHERE NOT contains(t, ':')
)"""


PAGES = _pages_of(PAGE_TEXT)
FORMED_TEXT = f"CASE WHEN lang = 'fr' THEN ({PAGE_TEXT}) || '{FORM_TEXT}' ELSE {PAGE_TEXT} END"

ARTICLES = f"""
article_rows AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, lang, {_title('text')} AS title, text
  FROM documents WHERE text IS NOT NULL AND text <> ''
)"""


def _compared(source: str) -> str:
    """Results, facets and outcome of ``basic-1`` and ``basic-2`` over a row source."""
    parts = []
    for version, pattern in (("old", WORDS_1), ("new", WORDS_2)):
        for slot in ("title", "text"):
            parts.append(f"{_tokens(slot, pattern)} AS {version}_{slot}_terms_l")
    results = []
    for version in ("old", "new"):
        for slot in ("title", "text"):
            terms = f"{version}_{slot}_terms_l"
            results.append(f"{_cost(terms)} AS {version}_{slot}_cost")
            results.append(f"{_pos(terms)} AS {version}_{slot}_pos_l")
    tests = []
    for slot in ("title", "text"):
        tests += [
            f"old_{slot}_cost <> new_{slot}_cost AS {slot}_cost",
            f"old_{slot}_terms_l <> new_{slot}_terms_l AS {slot}_term",
            f"old_{slot}_pos_l <> new_{slot}_pos_l AS {slot}_pos",
        ]
    return f"""
tokenized AS (SELECT *, {', '.join(parts)} FROM {source}),
analyzed AS (SELECT *, {', '.join(results)} FROM tokenized),
tested AS (SELECT *, {', '.join(tests)} FROM analyzed),
compared AS (
  SELECT *,
    title_cost OR title_term OR title_pos OR text_cost OR text_term OR text_pos AS has_difference,
    CASE WHEN coalesce(title, '') = '' AND coalesce(text, '') = '' THEN 1 ELSE 0 END AS skipped,
    list_filter([
      CASE WHEN title_cost THEN 'cost' END, CASE WHEN title_term THEN 'term' END,
      CASE WHEN title_pos THEN 'pos' END, CASE WHEN text_cost THEN 'cost' END,
      CASE WHEN text_term AND NOT title_term THEN 'term' END,
      CASE WHEN text_pos AND NOT title_pos THEN 'pos' END], lambda x: x IS NOT NULL) AS types
  FROM tested
)"""


OUTCOME = "skipped, has_difference, coalesce(array_to_string(types, ','), '') AS diff_types"


def _result_columns(name: str) -> str:
    return (
        f"{name}_cost, len({name}_terms_l)::BIGINT AS {name}_n, "
        f"{_joined(name + '_terms_l')} AS {name}_terms, {_joined(name + '_pos_l')} AS {name}_pos"
    )


RECORD = ", ".join(_result_columns(f"{v}_{s}") for v in ("old", "new") for s in ("title", "text"))
WITH_COMPARED = f"WITH {ARTICLES}, {_compared('article_rows')}"

COUNTS = """
counts AS (
  SELECT count(*) AS total_processed,
         count(*) FILTER (WHERE has_difference) AS difference_count,
         count(*) FILTER (WHERE NOT has_difference) AS match_count,
         coalesce(sum(skipped), 0)::BIGINT AS skipped_count,
         0::BIGINT AS failed_count
  FROM compared
), summary AS (
  SELECT *,
    CASE WHEN total_processed > 0
      THEN CAST(difference_count AS DOUBLE) / CAST(total_processed AS DOUBLE) * 100.0 ELSE 0.0
    END AS diff_rate,
    CASE WHEN total_processed > 0
      THEN CAST(match_count AS DOUBLE) / CAST(total_processed AS DOUBLE) * 100.0 ELSE 0.0
    END AS match_rate
  FROM counts
)"""

DUMP_COLUMNS = """
SELECT id, title, title_annotation, md5(text) AS text_md5, length(text)::BIGINT AS n,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS last_modified
FROM page_rows"""

LEXICON = f"""
words AS (
  SELECT surface, count(*) AS uses FROM (
    SELECT unnest(regexp_extract_all(text, '{WORDS_2}')) AS surface FROM benchmark
  ) GROUP BY surface
), lexicon AS (
  SELECT 'old' AS version, surface, (length(surface) * 10)::BIGINT AS cost,
         CASE WHEN length(surface) <= 3 THEN 'short' ELSE 'long' END AS pos
  FROM words
  UNION ALL
  SELECT 'new', surface, (length(surface) * 10)::BIGINT,
         CASE WHEN length(surface) <= 3 THEN 'short'
              WHEN length(surface) <= 8 THEN 'long' ELSE 'compound' END
  FROM words WHERE uses > 1
), fields AS (
  SELECT id, 'title' AS slot, {_tokens('title', WORDS_2)} AS terms FROM article_rows
  UNION ALL
  SELECT id, 'text', {_tokens('text', WORDS_2)} FROM article_rows
), tokens AS (
  SELECT id, slot, unnest(terms) AS surface, generate_subscripts(terms, 1) AS i FROM fields
), found AS (
  SELECT id, slot, v.version,
    coalesce(sum(coalesce(l.cost, 500)), 0)::BIGINT AS cost, count(*) AS n,
    list(surface ORDER BY i) AS terms,
    list(coalesce(l.pos, 'unknown') ORDER BY i) AS pos
  FROM tokens
  CROSS JOIN (VALUES ('old'), ('new')) v(version)
  LEFT JOIN lexicon l USING (version, surface)
  GROUP BY id, slot, v.version
)"""


def _lexicon_columns() -> tuple[str, str]:
    columns, joins = [], []
    for v in ("old", "new"):
        for s in ("title", "text"):
            f, name = f"{v}_{s}_f", f"{v}_{s}"
            joins.append(
                f"LEFT JOIN found {f} ON {f}.id = a.id AND {f}.slot = '{s}' "
                f"AND {f}.version = '{v}'"
            )
            columns.append(
                f"coalesce({f}.cost, 0)::BIGINT AS {name}_cost, "
                f"coalesce({f}.n, 0)::BIGINT AS {name}_n, "
                f"{_joined(f + '.terms')} AS {name}_terms, {_joined(f + '.pos')} AS {name}_pos"
            )
    return ", ".join(columns), " ".join(joins)


def _lexicon_query(difference: bool) -> str:
    columns, joins = _lexicon_columns()
    extra = ""
    if difference:
        pairs = [
            f"old_{s}_f.{c} IS DISTINCT FROM new_{s}_f.{c}"
            for s in ("title", "text")
            for c in ("cost", "terms", "pos")
        ]
        extra = f", ({' OR '.join(pairs)}) AS has_difference"
    return f"WITH {ARTICLES}, {LEXICON} SELECT a.id, {columns}{extra} FROM article_rows a {joins}"


# One step of the recursion for each place of the runs: of the paths that end there the best of each right
# context go on with the words that begin there.
LATTICE = rf"""
WITH RECURSIVE words AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM benchmark
), parts AS (
  SELECT w AS surface, 'word' AS pos, 300 + 30 * length(w) AS cost, 1 AS l, 1 AS r FROM words
  UNION SELECT left(w, 3), 'head', 180 + 20 * length(left(w, 3)), 1, 2 FROM words
  UNION SELECT substr(w, 4), 'tail', 90 + 35 * length(substr(w, 4)), 2, 3 FROM words
  UNION SELECT right(w, 2), 'end', 120 + 10 * length(right(w, 2)), 3, 1 FROM words
), lex AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY encode(surface), cost, l, r, pos) - 1 AS entry FROM parts WHERE surface <> ''
), links AS MATERIALIZED (
  SELECT r, l, (r * 7 + l * 5) % 4 * 60 AS cost FROM range(4) a(r), range(4) b(l)
), placed AS MATERIALIZED (
  SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n]+') AS runs FROM documents WHERE text <> '')
), runs AS MATERIALIZED (SELECT DISTINCT run, length(run) AS n FROM placed),
starts AS (SELECT run, n, unnest(range(n)) AS s FROM runs),
known AS MATERIALIZED (
  SELECT run, n, s, s + length(surface) AS e, entry, cost, l, r, surface, pos
  FROM (SELECT run, n, s, unnest(range(1, least(n - s, (SELECT max(length(surface)) FROM lex)) + 1)) AS size FROM starts)
  JOIN lex ON surface = substr(run, (s + 1)::INTEGER, size::INTEGER)
), nodes AS MATERIALIZED (
  SELECT * FROM known
  UNION ALL
  SELECT run, n, s, s + length(rest), -1, {LATTICE_UNKNOWN} + {LATTICE_LETTER} * length(rest), 3, 3, rest, 'unknown' FROM (
    SELECT run, n, s, regexp_extract(substr(run, (s + 1)::INTEGER), '^(\p{{L}}+|\p{{N}}+|.)') AS rest
    FROM starts ANTI JOIN known USING (run, s))
), paths AS (
  SELECT run, n, 0 AS step, 0::BIGINT AS e, 0::BIGINT AS cost, 0::BIGINT AS words, 0::BIGINT AS s, -1::BIGINT AS entry,
         0::BIGINT AS r, '' AS terms, '' AS pos FROM runs
  UNION ALL
  (WITH here AS (SELECT DISTINCT ON (run, r) * FROM paths WHERE e = step ORDER BY cost, words, s, entry)
   SELECT run, n, step + 1, e, cost, words, s, entry, r, terms, pos FROM paths WHERE e > step AND e < n
   UNION ALL
   SELECT * FROM (
     SELECT DISTINCT ON (a.run, w.s, w.e, w.entry) a.run, a.n, a.step + 1, w.e::BIGINT, (a.cost + k.cost + w.cost)::BIGINT,
            a.words + 1, w.s::BIGINT, w.entry::BIGINT, w.r::BIGINT,
            a.terms || CASE WHEN a.words > 0 THEN ' ' ELSE '' END || w.surface,
            a.pos || CASE WHEN a.words > 0 THEN ' ' ELSE '' END || w.pos
     FROM here a JOIN nodes w ON w.run = a.run AND w.s = a.step JOIN links k ON k.r = a.r AND k.l = w.l
     ORDER BY a.cost + k.cost, a.words, a.s, a.entry))
), cheapest AS MATERIALIZED (
  SELECT DISTINCT ON (run) run, p.cost + k.cost AS cost, words, terms, pos
  FROM paths p JOIN links k ON k.r = p.r AND k.l = 0 WHERE e = n
  ORDER BY p.cost + k.cost, words, s, entry)
SELECT CAST(doc_id AS VARCHAR) AS id, NULL::VARCHAR AS error, coalesce(sum(cost), 0)::BIGINT AS text_cost,
       coalesce(sum(words), 0)::BIGINT AS text_n, md5(coalesce(string_agg(terms, ' ' ORDER BY k), '')) AS text_terms,
       md5(coalesce(string_agg(pos, ' ' ORDER BY k), '')) AS text_pos
FROM (SELECT doc_id FROM documents WHERE text <> '') LEFT JOIN placed USING (doc_id) LEFT JOIN cheapest USING (run)
GROUP BY doc_id
"""

LONG_WORD = "len(list_filter({0}, lambda t: length(t) > 10)) > 0"
NUMBER = r"len(list_filter({0}, lambda t: regexp_matches(t, '^\p{{N}}'))) > 0"
FAILED_PATTERN = f"""
WITH {ARTICLES}, cut AS (
  SELECT id, title, text, {_tokens('title', WORDS_2)} AS a, {_tokens('text', WORDS_2)} AS b FROM article_rows
), told AS (
  SELECT *, CASE WHEN {LONG_WORD.format('a')} OR {LONG_WORD.format('b')} THEN 'cost'
                 WHEN {NUMBER.format('a')} OR {NUMBER.format('b')} THEN 'pos' END AS reason FROM cut)
SELECT id, reason IS NOT NULL AS failed, reason,
       CASE WHEN reason IS NULL AND coalesce(title, '') = '' AND coalesce(text, '') = '' THEN 1 ELSE 0 END AS skipped,
       reason IS NULL AND (len(a) > 0 OR len(b) > 0) AS has_difference,
       CASE WHEN reason IS NULL THEN coalesce(list_sum(list_transform(b, lambda t: length(t))), 0) ELSE -1 END::BIGINT AS text_cost
FROM told
"""


FACET_LINES = (
    ("cost", "cost", "CAST({0}_cost AS VARCHAR)"),
    ("term", "termList", "'[' || coalesce(array_to_string({0}_terms_l, ', '), '') || ']'"),
    ("pos", "posList", "'[' || coalesce(array_to_string({0}_pos_l, ', '), '') || ']'"),
)


def _record_lines() -> str:
    blocks = ["['Title: ' || title]"]
    for slot in ("title", "text"):
        for test, label, value in FACET_LINES:
            old, new = value.format(f"old_{slot}"), value.format(f"new_{slot}")
            blocks.append(
                f"CASE WHEN {slot}_{test} THEN ['analyze result[{label}] is different!!', "
                f"'  old[' || {old} || ']', '  new[' || {new} || ']'] ELSE [] END"
            )
    return f"flatten([{', '.join(blocks)}])"


def _escaped(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return f"replace({text}, chr(39), '&#39;')"


def _html_record() -> str:
    def item(label: str, value: str) -> str:
        return (
            "'                <div class=\"result-item\">' || chr(10) || "
            f"'                  <div class=\"result-label\">{label}:</div>' || chr(10) || "
            f"'                  <div class=\"result-value\">' || {value} || '</div>' || chr(10) || "
            "'                </div>' || chr(10)"
        )

    def panel(version: str) -> str:
        items = []
        for slot in ("title", "text"):
            name = f"{version}_{slot}"
            for label, part in (("Terms", "terms"), ("POS", "pos")):
                shown = f"'[' || coalesce(array_to_string({name}_{part}_l, ', '), '') || ']'"
                items.append(item(label, _escaped(shown)))
            items.append(item("Total Cost", f"CAST({name}_cost AS VARCHAR)"))
        return (
            f"'              <div class=\"comparison-panel {version}-panel\">' || chr(10) || "
            f"'                <h4>{version.upper()}</h4>' || chr(10) || "
            + " || ".join(items)
            + " || '              </div>' || chr(10)"
        )

    badges = (
        "coalesce(array_to_string(list_transform(types, lambda x: "
        "'<span class=\"diff-type ' || x || '\">' || upper(x) || '</span> '), ''), '')"
    )
    cut = _escaped("left(text, 500)")
    n = "CAST(row_no AS VARCHAR)"
    return (
        f"'        <tr id=\"row-' || {n} || '\">' || chr(10) || "
        f"'          <td>' || {n} || '</td>' || chr(10) || "
        f"'          <td>' || {_escaped('title')} || '</td>' || chr(10) || "
        f"'          <td>' || {badges} || '</td>' || chr(10) || "
        "'          <td><span class=\"toggle-detail\" onclick=\"toggleDetail(' || chr(39) || "
        f"'detail-' || {n} || chr(39) || ')\">表示/非表示</span></td>' || chr(10) || "
        "'        </tr>' || chr(10) || "
        f"'        <tr id=\"detail-' || {n} || '\" class=\"detail-row\">' || chr(10) || "
        "'          <td colspan=\"4\">' || chr(10) || "
        "'            <div class=\"comparison\">' || chr(10) || "
        f"{panel('old')} || {panel('new')} || "
        "'            </div>' || chr(10) || "
        "'            <details style=\"margin-top: 15px;\">' || chr(10) || "
        "'              <summary>元テキスト</summary>' || chr(10) || "
        "'              <div style=\"padding: 10px; background: #f9f9f9; margin-top: 10px; "
        "white-space: pre-wrap; font-size: 13px;\">' || "
        f"{cut} || CASE WHEN length(text) > 500 THEN '...(省略)' ELSE '' END || "
        "'</div>' || chr(10) || "
        "'            </details>' || chr(10) || "
        "'          </td>' || chr(10) || "
        "'        </tr>' || chr(10)"
    )


def _lines(values: list[str]) -> str:
    return " || ".join(f"{v} || chr(10)" for v in values)


def _html_cards() -> str:
    def card(kind: str, label: str, number: str, rate: str | None = None) -> list[str]:
        lines = [
            f"'      <div class=\"summary-card {kind}\">'",
            f"'        <div class=\"label\">{label}</div>'",
            f"'        <div class=\"number\">' || CAST({number} AS VARCHAR) || '</div>'",
        ]
        if rate:
            lines.append(f"'        <div class=\"label\">' || printf('%.2f%%', {rate}) || '</div>'")
        return [*lines, "'      </div>'"]

    return _lines([
        "'    <h2>処理結果サマリー</h2>'",
        "'    <div class=\"summary-section\">'",
        *card("info", "総処理数", "total_processed"),
        *card("warning", "差分あり", "difference_count", "diff_rate"),
        *card("success", "一致", "match_count", "match_rate"),
        *card("info", "スキップ", "skipped_count"),
        *card("warning", "失敗", "failed_count"),
        "'    </div>'",
    ])


def _html_info() -> str:
    def row(label: str, value: str) -> str:
        return f"'        <tr><th>{label}</th><td>{value}</td></tr>'"

    def components(label: str, names: list[str]) -> str:
        items = "".join(f"<li>{n}</li>" for n in names)
        return (
            f"'        <tr><td colspan=\"2\"><details><summary>{label} files ({len(names)} files)"
            f"</summary><ul class=\"jar-list\">{items}</ul></details></td></tr>'"
        )

    return _lines([
        "'    <div class=\"info-section\">'",
        "'      <h2>実行情報</h2>'",
        "'      <table class=\"info-table\">'",
        row("実行開始時刻", "2024-05-06 07:08:09"),
        row("実行終了時刻", "2024-05-06 08:10:12"),
        row("実行時間", "1時間2分3秒 (3723345 ms)"),
        row("Old JAR/Dir", "basic-1"),
        components("Old JAR", ["letters", "digits"]),
        row("New JAR/Dir", "basic-2"),
        components("New JAR", ["letters &amp; digits"]),
        row("Wiki40b Parquet", "documents"),
        row("最大レコード数", "全件処理"),
        "'      </table>'",
        "'    </div>'",
    ])


def _frame_lines() -> str:
    rule = "'========================================'"
    head = [
        rule, "'実行情報'", rule,
        "'実行開始時刻: 2024-05-06 07:08:09'",
        "'Old JAR/Dir: basic-1'", "'  - letters'", "'  - digits'",
        "'New JAR/Dir: basic-2'", "'  - letters & digits'",
        "'Wiki40b Parquet: documents'", "'最大レコード数: 全件処理'", "''",
        rule, "'差分詳細'", rule, "''",
    ]
    tail = [
        "''", rule, "'処理結果サマリー'", rule,
        "'実行終了時刻: 2024-05-06 08:10:12'", "'実行時間: 3723345 msec'",
        "'total processed: ' || CAST(total_processed AS VARCHAR)",
        "'falseCounter: ' || CAST(difference_count AS VARCHAR)",
        "'skippedCounter: ' || CAST(skipped_count AS VARCHAR)",
        "'failedCounter: ' || CAST(failed_count AS VARCHAR)",
    ]
    selects = [
        f"SELECT {section} AS section, {n} AS line_no, {line} AS line FROM summary"
        for section, lines in ((0, head), (2, tail))
        for n, line in enumerate(lines)
    ]
    return " UNION ALL ".join(selects)


def _preview_columns() -> str:
    columns = ["title", "md5(text) AS text_md5"]
    for v in ("old", "new"):
        columns += [
            f"coalesce(array_to_string({v}_title_terms_l, ' '), '') AS {v}_terms",
            f"coalesce(array_to_string({v}_title_pos_l, ' '), '') AS {v}_pos",
            f"{v}_title_cost AS {v}_total_cost",
        ]
    return ", ".join(columns)


ID = "CAST(doc_id AS VARCHAR) AS id"
DAMAGED = _by_lang("text", fr="text || chr(65533)", de="chr(65533) || '(' || text")
MARKED = _by_lang(
    "text",
    de="chr(10) || '_START_ARTICLE_' || chr(10) || ' ' || text",
    fr="'_START_SECTION_ x' || chr(10) || '_START_PARAGRAPH_' || chr(10) || chr(10) || text",
    es="chr(10) || ' _START_ARTICLE_ ' || chr(10) || '_START_SECTION_' || chr(10)",
)
BROKEN = _by_lang(
    "text",
    fr="replace(text, chr(10), chr(13) || chr(10))",
    de="replace(text, chr(10), chr(13))",
    es="replace(text, chr(10), ' ' || chr(9) || chr(10) || '  ' || chr(10) || ' ')",
)
STRIPPED = _by_lang(
    f"trim(text, {BLANKS})",
    fr=f"trim(text, {BLANKS})",
    de="chr(160) || ' ' || text || ' ' || chr(8239)",
    es="chr(8203) || ' ' || text || ' ' || chr(8199)",
)
AT_BOUNDARY = _by_lang(
    f"right(trim(text, {BLANKS}), 1) IN ('。', '．', '.', '!', '?', '！', '？')",
    fr="true", de="false", es="false",
)
DURATION = """
CASE WHEN ms // 3600000 > 0
  THEN printf('%d時間%d分%d秒 (%d ms)', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms)
WHEN ms // 60000 > 0
  THEN printf('%d分%d秒 (%d ms)', ms // 60000, ms // 1000 % 60, ms)
ELSE printf('%d秒 (%d ms)', ms // 1000, ms) END"""
SPLIT_WORDS = f"list_filter(regexp_split_to_array(trim(text, {BLANKS}), '\\s+'), lambda x: x <> '')"
SPLIT_TITLE = f"list_filter(regexp_split_to_array(trim(title, {BLANKS}), '\\s+'), lambda x: x <> '')"
ALL_TRIMMED = "chr(0) || chr(1) || chr(31) || " + BLANKS

ORACLES = {
    "xml_scan": f"WITH {PAGES} {DUMP_COLUMNS}",
    "xml_scan_compressed": f"WITH {PAGES} {DUMP_COLUMNS}",
    "gzip_ranges": f"WITH {PAGES} {DUMP_COLUMNS}",
    "xml_page_forms": f"""
        WITH {_pages_of(FORMED_TEXT)} {DUMP_COLUMNS}""",
    "limit_in_file": f"""
        WITH {PAGES}, first_rows AS (SELECT * FROM page_rows ORDER BY doc_id LIMIT {LIMIT}), {_compared('first_rows')}
        SELECT id, title, {OUTCOME} FROM compared""",
    "broken_files": f"""
        WITH {PAGES}, files AS (SELECT count(DISTINCT lang) AS n FROM documents WHERE lang IN ('fr', 'de'))
        SELECT (count(*) FILTER (lang IS NULL OR lang NOT IN ('fr', 'de')))::BIGINT AS total_processed,
          0::BIGINT AS failed_count, 0::BIGINT AS rejected_count, (SELECT n FROM files) AS broken_files,
          (SELECT n FROM files) * {BROKEN_BYTES} AS bytes_there, (SELECT n FROM files) AS cut
        FROM page_rows""",
    "xml_corrupt_filter": f"""
        SELECT {ID}, true AS intact, length({PAGE_TEXT})::BIGINT AS n FROM documents
        UNION ALL SELECT 'rejected', false, -1""",
    "parquet_scan": f"""
        SELECT {ID}, md5(text) AS text_md5, length(text)::BIGINT AS n FROM documents""",
    "empty_text_filter": f"""
        SELECT {ID}, length(text)::BIGINT AS n FROM documents WHERE lang NOT IN ('de', 'fr')""",
    "split_scan": f"""
        SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'test' END AS split,
               {ID}, md5(text) AS text_md5 FROM documents""",
    "parquet_audit": """
        SELECT table_name || '.parquet' AS file_name, true AS valid, 'ok' AS reason
        FROM information_schema.tables
        WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders',
          'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels',
          'conversations')
        UNION ALL SELECT 'text', false, 'bad magic'""",
    "admin_filter": f"""
        SELECT {ID}, {PAGE_TITLE} AS title FROM documents WHERE lang <> 'de'""",
    "trim_title": f"""
        SELECT {ID}, t AS title, length(t)::BIGINT AS n FROM (
          SELECT doc_id, ltrim({PAGE_TITLE}, {ALL_TRIMMED}) || chr(12288) AS t FROM documents)""",
    "title_annotation": f"""
        SELECT {ID}, {BARE_TITLE} AS title, {ANNOTATION} AS title_annotation FROM (
          SELECT doc_id, {PAGE_TITLE} AS t FROM documents)""",
    "derive_title": f"""
        SELECT {ID}, {_title('m')} AS title FROM (SELECT doc_id, {MARKED} AS m FROM documents)""",
    "normalize_text": f"""
        SELECT {ID}, md5(t) AS text_md5, length(t)::BIGINT AS n FROM (
          SELECT doc_id, {_normalized('b')} AS t FROM (
            SELECT doc_id, {BROKEN} AS b FROM documents))""",
    "strip_text": f"""
        SELECT {ID}, md5(t) AS text_md5, length(t)::BIGINT AS n FROM (
          SELECT doc_id, {STRIPPED} AS t FROM documents)""",
    "sentence_boundary": f"SELECT {ID}, {AT_BOUNDARY} AS at_boundary FROM documents",
    "utf8_decode": f"""
        SELECT {ID}, md5(t) AS text_md5, length(t)::BIGINT AS n FROM (
          SELECT doc_id, {DAMAGED} AS t FROM documents)""",
    "html_escape": f"""
        SELECT page_id, md5(h) AS html_md5, length(h)::BIGINT AS n FROM (
          SELECT page_id, {_escaped('html')} AS h FROM pages)""",
    "text_excerpt": f"""
        SELECT {ID}, md5(t) AS text_md5, length(t)::BIGINT AS n FROM (
          SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...(省略)'
                              ELSE text END AS t FROM documents)""",
    "format_duration": f"""
        SELECT l_orderkey, l_linenumber, ms, {DURATION} AS duration FROM (
          SELECT l_orderkey, l_linenumber,
                 (l_partkey * l_suppkey * l_linenumber * 7)::BIGINT AS ms FROM lineitem)""",
    "parse_timestamp": """
        SELECT event_id,
               CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS ts
        FROM events""",
    "tokenize": f"""
        SELECT {ID}, len(t)::BIGINT AS n, {_joined('t')} AS terms_md5 FROM (
          SELECT doc_id, {_tokens('text', WORDS_2)} AS t FROM documents)""",
    "analysis_result": f"""
        WITH {ARTICLES}, {_compared('article_rows')}
        SELECT id, old_text_cost AS text_cost, len(old_text_terms_l)::BIGINT AS text_n,
               {_joined('old_text_terms_l')} AS text_terms, {_joined('old_text_pos_l')} AS text_pos
        FROM analyzed""",
    "analyze_record": f"""
        {WITH_COMPARED} SELECT id, {_result_columns('new_title')}, {_result_columns('new_text')}
        FROM analyzed""",
    "dual_analyze": f"{WITH_COMPARED} SELECT id, {RECORD} FROM analyzed",
    "lexicon_tokenize": _lexicon_query(difference=True),
    "lexicon_shuffled": _lexicon_query(difference=False),
    "lattice_tokenize": LATTICE,
    "stream_lexicon": _lexicon_query(difference=True),
    "failed_pattern": FAILED_PATTERN,
    "skip_count": f"""
        WITH blanked AS (
          SELECT {_by_lang(_title('text'), de="''", es='NULL')} AS title,
                 {_by_lang('text', de='NULL', fr="''")} AS text FROM documents
        ), {_compared('blanked')}, {COUNTS}
        SELECT total_processed, difference_count, match_count, skipped_count, failed_count
        FROM summary""",
    "failed_split": f"""
        WITH {ARTICLES}, {_compared('article_rows')}, split AS (
          SELECT *, {SPLIT_WORDS} AS w, {SPLIT_TITLE} AS wt FROM analyzed
        ), judged AS (SELECT *, len(w) > {WORD_LIMIT} AS failed FROM split)
        SELECT id,
          CASE WHEN failed THEN 'ValueError: ' || CAST(len(w) AS VARCHAR) || ' words' END AS error,
          failed, 0 AS skipped, NOT failed AND (
            old_text_terms_l <> w OR old_title_terms_l <> wt
            OR list_distinct(old_text_pos_l) <> ['word'] OR list_distinct(old_title_pos_l) <> ['word']
            OR old_text_cost <> list_sum(list_transform(w, lambda x: length(x)))
          ) AS has_difference,
          CASE WHEN failed THEN -1 ELSE list_sum(list_transform(w, lambda x: length(x)))::BIGINT
          END AS text_cost,
          CASE WHEN failed THEN -1 ELSE len(w)::BIGINT END AS text_n
        FROM judged""",
    "facet_diffs": f"""
        {WITH_COMPARED} SELECT id, title_cost, title_term, title_pos, text_cost, text_term, text_pos
        FROM tested""",
    "diff_records": f"{WITH_COMPARED} SELECT id, title FROM compared WHERE has_difference",
    "diff_types": f"{WITH_COMPARED} SELECT id, {OUTCOME} FROM compared",
    "run_summary": f"""
        {WITH_COMPARED}, {COUNTS}
        SELECT 'basic-1' AS old_analyzer, 'basic-2' AS new_analyzer,
          'documents' AS source_path, 'Parquet' AS source_type, (-1)::BIGINT AS max_records,
          TIMESTAMP '2024-05-06 07:08:09' AS start_time,
          TIMESTAMP '2024-05-06 08:10:12.345' AS end_time, 3723345::BIGINT AS duration_ms,
          total_processed, difference_count, match_count, skipped_count, failed_count,
          diff_rate, match_rate
        FROM summary""",
    # An administrative page is dropped before its XML is parsed, cut or not.
    "xml_reject_counts": f"""
        WITH {PAGES} SELECT count(*) AS total_processed, 0::BIGINT AS failed_count,
          (count(*) FILTER (doc_id = (SELECT max(doc_id) FROM documents)))::BIGINT AS rejected_count
        FROM page_rows""",
    "run_info_components": f"""
        {WITH_COMPARED}
        SELECT 'basic-1' AS old_analyzer, 'basic-2' AS new_analyzer, 'letters,digits' AS old_components,
          'letters & digits' AS new_components, 32::BIGINT AS run_id_length, count(*) AS total_processed
        FROM compared""",
    "html_summary": f"""
        {WITH_COMPARED}, {COUNTS}
        SELECT {_html_info()} AS info, {_html_cards()} AS cards,
          '    <h2>差分詳細 (' || CAST(difference_count AS VARCHAR) || '件)</h2>' || chr(10) ||
          CASE WHEN difference_count = 0 THEN '    <p>差分はありません。</p>' || chr(10) ELSE '' END
          AS details
        FROM summary""",
    "limit_records": f"""
        WITH {ARTICLES} SELECT id, title FROM article_rows ORDER BY doc_id LIMIT {LIMIT}""",
    "input_order": f"""
        SELECT {ID}, row_number() OVER (ORDER BY doc_id) AS position FROM documents""",
    "preview": f"""
        {WITH_COMPARED} SELECT {_preview_columns()} FROM (
          SELECT * FROM analyzed ORDER BY doc_id LIMIT {PREVIEW})""",
    "text_report_lines": f"""
        {WITH_COMPARED}, reported AS (
          SELECT id, {_record_lines()} AS lines FROM compared WHERE has_difference
        ), numbered AS (
          SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS n FROM reported)
        SELECT id, n::INTEGER AS line_no, md5(line) AS line_md5 FROM numbered""",
    "report_summary_lines": f"{WITH_COMPARED}, {COUNTS} {_frame_lines()}",
    "html_report_rows": f"""
        {WITH_COMPARED}, numbered AS (
          SELECT *, row_number() OVER (ORDER BY doc_id) AS row_no
          FROM compared WHERE has_difference
        ), html AS (SELECT id, row_no, {_html_record()} AS h FROM numbered)
        SELECT id, row_no, md5(h) AS html_md5, length(h)::BIGINT AS n FROM html""",
    "dump_compare": f"""
        WITH {PAGES}, {_compared('page_rows')} SELECT id, title, {OUTCOME} FROM compared""",
    "parquet_compare": f"{WITH_COMPARED} SELECT id, title, {OUTCOME} FROM compared",
    "stream_compare": f"{WITH_COMPARED} SELECT id, title, {OUTCOME} FROM compared",
    "stream_dump_compare": f"""
        WITH {PAGES}, {_compared('page_rows')} SELECT id, title, {OUTCOME} FROM compared""",
    # The English shard arrives twice, the second time between two rounds.
    "stream_summary": f"""
        {WITH_COMPARED}, twice AS (SELECT * FROM compared UNION ALL SELECT * FROM compared WHERE lang = 'en')
        SELECT count(*) AS total_processed, count(*) FILTER (has_difference) AS difference_count,
          coalesce(sum(skipped), 0)::BIGINT AS skipped_count, 0::BIGINT AS failed_count
        FROM twice""",
    "source_reports": f"""
        {WITH_COMPARED}
        SELECT id || ' ' || array_to_string(types, ',') AS line FROM compared WHERE has_difference
        UNION ALL SELECT 'of ' || count(*) FROM compared""",
    "job_reports": f"""
        {WITH_COMPARED}
        SELECT count(*) FILTER (has_difference) AS text_titles,
          coalesce(sum(title_cost::INT + title_term::INT + title_pos::INT + text_cost::INT + text_term::INT + text_pos::INT), 0)::BIGINT
            AS text_facets,
          1::BIGINT AS text_summaries, (2 * count(*) FILTER (has_difference))::BIGINT AS html_rows
        FROM compared""",
}
