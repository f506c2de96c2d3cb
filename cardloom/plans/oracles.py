"""DuckDB SQL of the queries, written apart from the Spark operators."""

from __future__ import annotations

import math

from cardloom.plans import fixtures as X

# Fixed values, written again so that a wrong one on either side shows.
LABELS = {
    "numero_documento": ["NUMERO", "NÚMERO", "NUM", "NUM.", "NUMERO DE DOCUMENTO", "DOCUMENTO", "IDENTIFICACION", "IDENTIFICACIÓN"],
    "apellidos": ["APELLIDOS", "APELLIDO", "APEL"],
    "nombres": ["NOMBRES", "NOMBRE", "NOMB", "NOM"],
    "fecha_nacimiento": ["FECHA DE NACIMIENTO", "FECHA DE NACIMIENTO:", "FECHA NACIMIENTO", "NACIMIENTO"],
    "lugar_nacimiento": ["LUGAR DE NACIMIENTO", "LUGAR DE NACIMIETO", "LUGAR NACIMIENTO", "LUGAR"],
    "nacionalidad": ["NACIONALIDAD", "NACIONAL"],
    "tipo_sangre": ["G.S. RH", "G. S. RH", "GS RH", "G S RH", "RH", "TIPO DE SANGRE"],
    "sexo": ["SEXO"],
    "estatura": ["ESTATURA"],
    "fecha_expedicion": ["FECHA Y LUGAR DE EXPEDICION", "FECHA Y LUGAR DE EXPEDICIÓN", "FECHA EXPEDICION", "FECHA EXPEDICIÓN"],
}
SIDES = {
    "front": ["NUMERO", "NÚMERO", "APELLIDOS", "NOMBRES"],
    "back": ["FECHA DE NACIMIENTO", "LUGAR DE NACIMIENTO", "NACIONALIDAD", "ESTATURA", "SEXO", "RH", "G.S. RH", "FECHA Y LUGAR DE EXPEDICION"],
}
SIDE_FIELDS = {"anverso": ["numero_documento", "apellidos", "nombres"], "reverso": ["fecha_nacimiento", "lugar_nacimiento", "nacionalidad", "tipo_sangre", "sexo"]}
SIDE_FIELDS["desconocido"] = SIDE_FIELDS["anverso"] + SIDE_FIELDS["reverso"]
ZONES = {
    "anverso": {"numero_documento": (0.04, 0.26, 0.85, 0.36), "apellidos": (0.04, 0.34, 0.50, 0.44), "nombres": (0.04, 0.46, 0.99, 0.60)},
    "reverso": {"fecha_nacimiento": (0.45, 0.07, 0.72, 0.14), "lugar_nacimiento": (0.10, 0.07, 0.42, 0.16), "tipo_sangre": (0.48, 0.16, 0.62, 0.23), "sexo": (0.68, 0.16, 0.78, 0.23)},
    "digital": {
        "numero_documento": (0.65, 0.08, 0.95, 0.13), "nombre_completo": (0.15, 0.25, 0.85, 0.32), "fecha_nacimiento": (0.15, 0.35, 0.40, 0.40), "sexo": (0.45, 0.35, 0.55, 0.40),
        "lugar_nacimiento": (0.15, 0.45, 0.55, 0.50), "nacionalidad": (0.60, 0.45, 0.85, 0.50), "tipo_sangre": (0.75, 0.55, 0.95, 0.60),
    },
}
FIELDS = ["numero_documento", "apellidos", "nombres", "nombre_completo", "fecha_nacimiento", "sexo", "lugar_nacimiento", "nacionalidad", "tipo_sangre"]

MONTHS = "['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC']"
ALL_MONTHS = "['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC','JAN','APR','AUG','DEC']"
MONTH_NUMBERS = "[1,2,3,4,5,6,7,8,9,10,11,12,1,4,8,12]"
NAMED = r"(\d{1,2})[-/\s]([A-ZÁÉÍÓÚ]{3})[-/\s](\d{4})"
PLAIN = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normal(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(upper(coalesce({x}, ''))), '[^A-Z0-9+#.]+', ' ', 'g'))"


def upper_plain(x: str) -> str:
    return f"upper(translate({x}, 'ÁÉÍÓÚ', 'AEIOU'))"


def digits(x: str) -> str:
    return f"nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '')"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


def clean_text(x: str) -> str:
    kept = rf"trim(regexp_replace(regexp_replace({x}, '[^A-Za-zÁÉÍÓÚÑáéíóúñ\s]', '', 'g'), '\s+', ' ', 'g'))"
    return f"nullif({title(kept)}, '')"


def day(y: str, m: str, d: str) -> str:
    return f"try_strptime({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d')"


def parse_date(x: str) -> str:
    raw = f"upper({strip(x)})"
    g = lambda p, n: f"regexp_extract({raw}, '{p}', {n})"
    month = f"coalesce(list_position({MONTHS}, {g(NAMED, 2)}), 0)"
    named = day(g(NAMED, 3), f"CAST({month} AS VARCHAR)", g(NAMED, 1))
    return f"strftime(CASE WHEN {month} > 0 THEN {named} WHEN {g(PLAIN, 0)} <> '' THEN {day(g(PLAIN, 3), g(PLAIN, 2), g(PLAIN, 1))} END, '%Y-%m-%d')"


def sex(x: str) -> str:
    up = f"upper({strip(x)})"
    return f"CASE WHEN starts_with({up}, 'M') THEN 'Masculino' WHEN starts_with({up}, 'F') THEN 'Femenino' END"


def blood(x: str) -> str:
    return f"nullif(regexp_extract(replace(replace(upper({x}), ' ', ''), '0', 'O'), '(AB|A|B|O)[+-]', 0), '')"


def valid(f: str, x: str) -> str:
    v = strip(x)
    long = f"(length({v}) >= 3 AND length(replace({v}, ' ', '')) >= 3)"
    return f"""coalesce({v} <> '' AND CASE {f} WHEN 'numero_documento' THEN regexp_full_match({v}, '[0-9]{{6,12}}')
      WHEN 'fecha_nacimiento' THEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime({v}, '%Y-%m-%d') IS NOT NULL
      WHEN 'sexo' THEN {v} IN ('Masculino', 'Femenino') WHEN 'tipo_sangre' THEN regexp_full_match({v}, '(AB|A|B|O)[+-]')
      WHEN 'apellidos' THEN {long} WHEN 'nombres' THEN {long} WHEN 'nombre_completo' THEN {long} WHEN 'lugar_nacimiento' THEN {long} WHEN 'nacionalidad' THEN {long}
      ELSE true END, false)"""


def cleaned(f: str, x: str) -> str:
    return f"CASE {f} WHEN 'numero_documento' THEN {digits(x)} WHEN 'fecha_nacimiento' THEN {parse_date(x)} WHEN 'sexo' THEN {sex(x)} WHEN 'tipo_sangre' THEN {blood(x)} ELSE {clean_text(x)} END"


def age(x: str, as_of: str = X.AS_OF) -> str:
    dashed = f"replace({x}, ',', '')"
    three = f"len(string_split({dashed}, '-')) = 3"
    p1, p2 = "^([0-9]{1,2})-([A-Za-z]{3})-([0-9]{4})$", r"^\s*([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{4})\s*$"
    g = lambda n: f"CASE WHEN {three} THEN regexp_extract({dashed}, '{p1}', {n}) ELSE regexp_extract({x}, '{p2}', {n}) END"
    month = f"({MONTH_NUMBERS})[list_position({ALL_MONTHS}, upper({g(2)}))]"
    born = day(g(3), f"CAST({month} AS VARCHAR)", g(1))
    return f"CAST(year(DATE '{as_of}') - year({born}) - CAST(month(DATE '{as_of}') * 100 + day(DATE '{as_of}') < month({born}) * 100 + day({born}) AS INTEGER) AS INTEGER)"


def over_raw(columns: str) -> str:
    return f"WITH raw AS ({X.RAW_SQL}) SELECT doc_id, {columns} FROM raw"


def filled(*xs: str) -> str:
    return " + ".join(f"CAST(nullif({x}, '') IS NOT NULL AS INTEGER)" for x in xs)


def lenient(x: str) -> str:
    p = r"^(\d{1,2})[-\s]([A-ZÁÉÍÓÚ]{3})[-\s](\d{4})"
    g = lambda n: f"regexp_extract(upper({x}), '{p}', {n})"
    month = f"CAST(coalesce(nullif(list_position({MONTHS}, {g(2)}), 0), 1) AS VARCHAR)"
    return f"CASE WHEN regexp_matches(upper({x}), '{p}') THEN {g(3)} || '-' || lpad({month}, 2, '0') || '-' || lpad({g(1)}, 2, '0') ELSE coalesce({strip(x)}, '') END"


LINES = rf"""pages AS ({X.CARD_SQL}), parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM pages WHERE text <> ''),
cut AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS raw FROM cut)"""
HEAD = "(" + " OR ".join(f"contains({upper_plain(strip('raw'))}, '{h}')" for h in ("REPUBLICA", "COLOMBIA", "IDENTIFICACION", "IDENTIFICACIÓN", "CEDULA")) + ")"
TRIMMED = rf"""{LINES}, marked AS (SELECT *, least(3, coalesce(min(CASE WHEN NOT {HEAD} THEN line_no END) OVER (PARTITION BY doc_id), max(line_no) OVER (PARTITION BY doc_id) + 1)) AS gone FROM lines),
body AS (SELECT doc_id, CAST(line_no - gone AS INTEGER) AS line_no, raw FROM marked WHERE line_no >= gone)"""
CONTEXT = rf"""{TRIMMED}, seen AS (SELECT doc_id, line_no, raw, {upper_plain(strip('raw'))} AS plain FROM body),
ctx AS (SELECT *, {strip('lag(raw, 1) OVER w')} AS before, {strip('lag(raw, 2) OVER w')} AS before2, {strip('lead(raw, 1) OVER w')} AS after,
  coalesce(last_value(CASE WHEN regexp_matches(plain, 'APELLIDOS?|NOMBRES?') THEN 'antigua' WHEN contains(plain, 'NUIP') THEN 'nueva' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'desconocido') AS kind
  FROM seen WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
WORD = "A-Za-z0-9_ÁÉÍÓÚÑáéíóúñÜü"


def short_blood(x: str) -> str:
    """Group 2 is the blood type between word edges."""
    return f"nullif(regexp_extract({x}, '(^|[^{WORD}])([OAB][+-])[{WORD}]', 2), '')"


WRITES = {
    "numero_documento": "CASE WHEN regexp_matches(plain, 'NUMER[O0]') OR contains(plain, 'NUIP') THEN regexp_replace(after, '[^0-9]', '', 'g') END",
    "fecha_nacimiento": "CASE WHEN contains(plain, 'FECHA DE NACIMIENTO') THEN after END",
    "lugar_nacimiento": "CASE WHEN contains(plain, 'LUGAR DE NACIMIENTO') THEN replace(before2 || ' ' || before, '!', 'P') END",
    "sexo": "CASE WHEN contains(plain, 'SEXO') THEN CASE WHEN starts_with(upper(after), 'M') THEN 'Masculino' WHEN starts_with(upper(after), 'F') THEN 'Femenino' END END",
    "fecha_expedicion": "CASE WHEN contains(plain, 'EXPEDICION') THEN before END",
    "nombre_completo": f"CASE WHEN kind = 'antigua' AND nullif(before, '') IS NOT NULL AND regexp_matches(plain, 'APELLIDO|NOMBRE') THEN {strip('''(CASE WHEN contains(plain, 'NOMBRE') THEN before ELSE '' END || ' ' || CASE WHEN contains(plain, 'APELLIDO') THEN before ELSE '' END)''')} END",
    "rh": f"coalesce(CASE WHEN kind = 'nueva' AND {short_blood('plain')} IS NOT NULL THEN {strip('plain')} END, CASE WHEN contains(plain, 'RH') THEN {short_blood('before')} END)",
    "nacionalidad": "CASE WHEN kind = 'nueva' AND contains(plain, 'NACIONALIDAD') THEN after END",
}
FOLDED = ", ".join(f"arg_max({v}, line_no) FILTER (WHERE ({v}) IS NOT NULL) AS {k}" for k, v in WRITES.items())
NUMBER = "list_filter(regexp_extract_all(text, '[0-9]{8,10}', 0), lambda x: length(x) = list_max(list_transform(regexp_extract_all(text, '[0-9]{8,10}', 0), lambda y: length(y))))[1]"
_CAPITALS = r"list_filter(regexp_extract_all(text, '[A-ZÁÉÍÓÚÑ]{3,}(?:\s+[A-ZÁÉÍÓÚÑ]{3,}){1,3}', 0), lambda x: NOT contains(x, 'COLOMBIA') AND NOT contains(x, 'IDENTIFICACION'))[1]"
NAME = f"array_to_string(list_transform(string_split({_CAPITALS}, chr(10)), lambda l: {title('l')}), chr(10))"
BY_LINES = f"""WITH {CONTEXT}, f AS (SELECT doc_id, {FOLDED} FROM ctx GROUP BY doc_id)
SELECT p.doc_id, coalesce(nullif(f.nombre_completo, ''), nullif({NAME}, ''), f.nombre_completo) AS nombre_completo,
  coalesce(nullif(f.numero_documento, ''), {NUMBER}, f.numero_documento) AS numero_documento,
  f.fecha_nacimiento, f.sexo, f.lugar_nacimiento, f.fecha_expedicion, f.nacionalidad, f.rh, {age('f.fecha_nacimiento')} AS edad
FROM pages p LEFT JOIN f USING (doc_id)"""
BORN = f"coalesce(nullif(f.fecha_nacimiento, ''), nullif(regexp_extract(text, '[0-9]{{2}}-[A-Z]{{3}}-[0-9]{{4}}', 0), ''), f.fecha_nacimiento)"
WIDER = BY_LINES.replace("f.fecha_nacimiento, f.sexo, ", f"{BORN} AS fecha_nacimiento, coalesce(f.sexo, CASE WHEN regexp_matches(text, '(^|[^{WORD}])M($|[^{WORD}])') THEN 'Masculino' WHEN regexp_matches(text, '(^|[^{WORD}])F($|[^{WORD}])') THEN 'Femenino' END) AS sexo, ")
WIDER = WIDER.replace("f.rh, ", f"coalesce(nullif(f.rh, ''), {short_blood('text')}, f.rh) AS rh, ").replace(age("f.fecha_nacimiento"), age(BORN))
_N = r"([A-ZÁÉÍÓÚÑ\s]+)"
PATTERNS = {
    "numero_documento": rf"nullif(regexp_extract(text, '(^|[^{WORD}])([0-9]{{6,15}})($|[^{WORD}])', 2), '')",
    "nombre_completo": clean_text(rf"nullif(regexp_extract(text, '(?i)(?:NOMBRE|NOMBRES?)\s*:?\s*{_N}', 1), '')"),
    "fecha_nacimiento": parse_date(r"nullif(regexp_extract(text, '(\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{4})', 1), '')"),
    "sexo": sex(r"nullif(regexp_extract(text, '(?i)(SEXO|GENERO)\s*:?\s*([MF])', 2), '')"),
    "lugar_nacimiento": clean_text(rf"nullif(regexp_extract(text, '(?i)(?:LUGAR|CIUDAD)\s*(?:DE)?\s*NACIMIENTO\s*:?\s*{_N}', 1), '')"),
    "nacionalidad": clean_text(rf"nullif(regexp_extract(text, '(?i)(NACIONALIDAD)\s*:?\s*{_N}', 2), '')"),
    "tipo_sangre": blood(r"nullif(regexp_extract(text, '(?i)(TIPO\s*(?:DE)?\s*SANGRE|RH)\s*:?\s*([A-Z0-9+-]+)', 2), '')"),
}
_C = f"c AS ({X.CANDIDATES_SQL})"
MERGED = f"""{_C}, t AS MATERIALIZED (SELECT doc_id, field, arg_min(value, page_no) AS value FROM c WHERE source = 'text' AND {valid('field', 'value')} GROUP BY ALL),
g AS MATERIALIZED (SELECT doc_id, field, arg_max(value, page_no) AS value FROM c WHERE source = 'general' AND {valid('field', 'value')} GROUP BY ALL),
k AS MATERIALIZED (SELECT doc_id, field, page_no, {cleaned('field', 'value')} AS v FROM c WHERE source = 'crop'),
z AS MATERIALIZED (SELECT doc_id, field, arg_max(v, page_no) AS value FROM k WHERE {valid('field', 'v')} GROUP BY ALL)"""
#: Both sources' latest values of a field, valid or not, and what is known of each once.
LATEST = f"""{_C}, j AS MATERIALIZED (SELECT doc_id, field, a.value AS general, b.value AS crop FROM (SELECT doc_id, field, arg_max_null(value, page_no) AS value FROM c WHERE source = 'general' GROUP BY ALL) a
  FULL JOIN (SELECT doc_id, field, arg_max_null(value, page_no) AS value FROM c WHERE source = 'crop' GROUP BY ALL) b USING (doc_id, field))"""
COMPARED = f"""{LATEST}, k AS MATERIALIZED (SELECT *, {valid('field', 'general')} AS gv, {valid('field', 'crop')} AS cv, {normal('general')} AS gn, {normal('crop')} AS cn FROM j)
  SELECT doc_id, field, general, crop, CASE WHEN gv THEN general WHEN cv THEN crop END AS value, CASE WHEN gv THEN 'OCR_GENERAL' WHEN cv THEN 'OCR_CROP' ELSE 'NINGUNO' END AS origen,
  gv AS general_valido, cv AS crop_valido, gv AND cv AND gn = cn AS coinciden FROM k"""


def score(f: str, x: str, origin: int) -> str:
    v = strip(x)
    return f"""CASE WHEN {valid(f, x)} THEN 50 + {origin} + CASE WHEN {f} = 'numero_documento' THEN CASE WHEN regexp_full_match({x}, '[0-9]{{8,10}}') THEN 25 ELSE 0 END
      WHEN {f} IN ('apellidos', 'nombres') THEN CASE WHEN len(list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w <> '')) >= 2 THEN 20 ELSE 0 END
      WHEN {f} IN ('tipo_sangre', 'sexo', 'fecha_nacimiento') THEN 30 ELSE 0 END ELSE 0 END"""


WORDS = f"""w AS (SELECT * REPLACE ({strip('text')} AS text), {normal('text')} AS norm, x + w / 2 AS cx, y + h / 2 AS cy FROM ({X.WORDS_SQL}) WHERE {strip('text')} <> '' AND coalesce(conf, 0) >= 15),
d AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, norm, round_even(x / 10, 0), round_even(y / 10, 0) ORDER BY config_ord, word_ord) = 1)"""
#: Words pass by height, a step for each of a page; a word joins the first line whose mean is near enough. Use with WITH RECURSIVE.
CLUSTERED = f"""{WORDS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY cy, x, config_ord, word_ord) AS k FROM d),
walk AS (SELECT DISTINCT doc_id, page_no, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(t DOUBLE, n BIGINT, h INTEGER)[]) AS ls, CAST(-1 AS BIGINT) AS line_id FROM o
  UNION ALL SELECT doc_id, page_no, k, CASE WHEN p IS NULL THEN list_append(ls, {{'t': cy, 'n': CAST(1 AS BIGINT), 'h': h}}) ELSE list_transform(ls, lambda l, i: CASE WHEN i = p THEN {{'t': l.t + cy, 'n': l.n + 1, 'h': greatest(l.h, h)}} ELSE l END) END, coalesce(p - 1, len(ls))
  FROM (SELECT o.doc_id, o.page_no, o.k, o.cy, o.h, w.ls, nullif(list_position(list_transform(w.ls, lambda l: abs(o.cy - l.t / l.n) <= greatest(12.0, greatest(l.h, o.h) * 0.6)), true), 0) AS p
    FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.page_no = w.page_no AND o.k = w.k + 1)),
b AS MATERIALIZED (SELECT o.*, CAST(walk.line_id AS INTEGER) AS line_id FROM o JOIN walk USING (doc_id, page_no, k))"""
_BY_X = "ORDER BY x, cy, config_ord, word_ord"
LINED = f"""{CLUSTERED}, l AS (
  SELECT doc_id, page_no, line_id, string_agg(text, ' ' {_BY_X}) AS text, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2,
    list_filter(list({normal('text')} {_BY_X}), lambda t: t IN ('M', 'F')) AS letters FROM b GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY (y1 + y2) / 2, line_id) - 1 AS INTEGER) AS line_no, text, {normal('text')} AS norm, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, letters FROM l)"""


def ratios(pairs: str, tag: str = "") -> str:
    """CTEs up to `ratio` with a tag (a, b, s): twice the matching blocks over both lengths for pairs (a, b), 0, 1 or 0.95 where that is settled. Use with WITH RECURSIVE.

    Blocks come from runs of equal characters on a diagonal, cut to the stretches that are still open; the longest goes
    first, then the one that starts first in a and then in b, and leaves a stretch on either side.
    """
    return f"""pairs{tag} AS MATERIALIZED (SELECT DISTINCT a, b FROM ({pairs})),
open_{tag} AS MATERIALIZED (SELECT a, b FROM pairs{tag} WHERE a <> '' AND b <> '' AND NOT contains(a, b) AND NOT contains(b, a)),
ca{tag} AS (SELECT a, CAST(i AS INTEGER) AS i, a[i] AS ch FROM (SELECT DISTINCT a FROM open_{tag}), LATERAL (SELECT unnest(range(1, length(a) + 1)) AS i)),
cb{tag} AS (SELECT b, CAST(j AS INTEGER) AS j, b[j] AS ch FROM (SELECT DISTINCT b FROM open_{tag}), LATERAL (SELECT unnest(range(1, length(b) + 1)) AS j)),
cells{tag} AS (SELECT a, b, i, i - j AS dg, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM open_{tag} JOIN ca{tag} x USING (a) JOIN cb{tag} y USING (b) WHERE x.ch = y.ch),
runs{tag} AS MATERIALIZED (SELECT a, b, dg, min(i) AS i, CAST(count(*) AS INTEGER) AS n FROM cells{tag} GROUP BY a, b, dg, g),
blocks{tag} AS (SELECT a, b, 1 AS al, CAST(length(a) AS INTEGER) + 1 AS ah, 1 AS bl, CAST(length(b) AS INTEGER) + 1 AS bh, 0 AS m FROM open_{tag}
  UNION ALL SELECT a, b, v.al, v.ah, v.bl, v.bh, v.m FROM (
    SELECT a, b, unnest([{{'al': al, 'ah': -x.i, 'bl': bl, 'bh': -x.j, 'm': 0}}, {{'al': x.n - x.i, 'ah': ah, 'bl': x.n - x.j, 'bh': bh, 'm': 0}}, {{'al': 0, 'ah': 0, 'bl': 0, 'bh': 0, 'm': x.n}}]) AS v
    FROM (SELECT a, b, al, ah, bl, bh, max({{'n': least(r.i + r.n, ah, bh + r.dg) - greatest(r.i, al, bl + r.dg), 'i': -greatest(r.i, al, bl + r.dg), 'j': r.dg - greatest(r.i, al, bl + r.dg)}}) AS x
      FROM blocks{tag} k JOIN runs{tag} r USING (a, b) WHERE k.al < k.ah AND k.bl < k.bh AND least(r.i + r.n, ah, bh + r.dg) > greatest(r.i, al, bl + r.dg) GROUP BY a, b, al, ah, bl, bh))
  WHERE v.m > 0 OR (v.al < v.ah AND v.bl < v.bh)),
ratio{tag} AS MATERIALIZED (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.95 ELSE 2.0::DOUBLE * coalesce(m, 0) / (length(a) + length(b)) END AS s
  FROM pairs{tag} LEFT JOIN (SELECT a, b, sum(m) AS m FROM blocks{tag} GROUP BY a, b) USING (a, b))"""


def table_of(name: str, rows: dict[str, list[str]]) -> str:
    listed = ", ".join(f"('{k}', {i}, '{x}')" for k, xs in rows.items() for i, x in enumerate(xs))
    return f"{name} AS MATERIALIZED (SELECT k, i, x, {normal('x')} AS xn FROM (VALUES {listed}) AS v(k, i, x))"


_LONG_WORDS = "list_filter(string_split(norm, ' '), lambda w: length(w) >= 3)"
#: The label that each field has on a page, and whether a line is one.
FOUND = f"""{LINED}, {table_of('lab', LABELS)}, pc AS MATERIALIZED (SELECT DISTINCT norm, unnest(list_distinct(list_append({_LONG_WORDS}, norm))) AS piece FROM n),
{ratios("SELECT piece AS a, xn AS b FROM (SELECT DISTINCT piece FROM pc), lab")},
best AS MATERIALIZED (SELECT norm, k AS field, i, x, xn, max(CASE WHEN contains(norm, xn) THEN greatest(s, 0.96) ELSE s END) AS s FROM pc, lab, ratio WHERE ratio.a = piece AND ratio.b = xn GROUP BY norm, k, i, x, xn),
found AS MATERIALIZED (SELECT doc_id, page_no, field, line_no, x AS label, xn AS label_norm, s AS score FROM n JOIN best USING (norm) WHERE s >= 0.62 QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, field ORDER BY s DESC, line_no, i) = 1),
islab AS MATERIALIZED (SELECT norm, norm <> '' AND bool_or(contains(norm, b) OR s >= 0.75) AS is_label FROM (SELECT DISTINCT norm FROM n) JOIN ratio ON ratio.a = norm GROUP BY norm)"""
SIDE_PART = f"""{table_of('sid', SIDES)}, pg AS MATERIALIZED (SELECT doc_id, page_no, trim(regexp_replace(string_agg(norm, ' ' ORDER BY line_no), ' +', ' ', 'g')) AS whole FROM n GROUP BY ALL),
pw AS MATERIALIZED (SELECT doc_id, page_no, unnest(list_distinct(string_split(whole, ' '))) AS word FROM pg),
{ratios("SELECT word AS a, xn AS b FROM (SELECT DISTINCT word FROM pw WHERE word <> ''), sid", "_side")},
near AS MATERIALIZED (SELECT doc_id, page_no, b AS xn FROM pw JOIN ratio_side ON a = word WHERE s >= 0.70 GROUP BY ALL),
pts AS (SELECT doc_id, page_no, k, sum(CASE WHEN contains(whole, xn) THEN 2 WHEN near.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS p FROM pg CROSS JOIN sid LEFT JOIN near USING (doc_id, page_no, xn) GROUP BY ALL),
side AS MATERIALIZED (SELECT doc_id, page_no, front, back, CASE WHEN front > back THEN 'anverso' WHEN back > front THEN 'reverso' ELSE 'desconocido' END AS lado
  FROM (SELECT doc_id, page_no, CAST(sum(p) FILTER (WHERE k = 'front') AS INTEGER) AS front, CAST(sum(p) FILTER (WHERE k = 'back') AS INTEGER) AS back FROM pts GROUP BY ALL))"""


def _clean_valid(field: str, x: str) -> str:
    return f"CASE WHEN {valid(field, clean_text(x))} THEN {clean_text(x)} END"


_REST = "trim(replace(norm, label_norm, ''))"
#: What the lines around a label say of its field, and the value of each label.
LABELLED = f"""{FOUND}, near_lines AS MATERIALIZED (SELECT f.doc_id, f.page_no, f.field, f.label_norm, l.line_no - f.line_no AS dist, l.text, l.norm, l.letters, is_label, text <> '' AND NOT is_label AS is_plain
  FROM found f JOIN n l ON l.doc_id = f.doc_id AND l.page_no = f.page_no AND l.line_no BETWEEN f.line_no - 3 AND f.line_no + 2 JOIN islab ON islab.norm = l.norm),
said AS (SELECT *, CASE WHEN field = 'numero_documento' AND dist >= 0 THEN nullif(regexp_extract(text, '[0-9]{{6,12}}', 0), '') WHEN field = 'fecha_nacimiento' AND dist >= 0 THEN {parse_date('text')}
    WHEN field = 'tipo_sangre' AND dist >= 0 THEN {blood('text')} WHEN field = 'sexo' AND dist >= 0 THEN {sex('CASE WHEN dist = 0 THEN letters[-1] ELSE letters[1] END')}
    WHEN field IN ('apellidos', 'nombres') AND dist IN (-1, -2) AND is_plain THEN {_clean_valid('field', 'text')}
    WHEN field = 'nacionalidad' AND dist = 0 AND length({_REST}) >= 3 THEN {_clean_valid('field', _REST)} WHEN field = 'nacionalidad' AND dist > 0 AND is_plain THEN {_clean_valid('field', 'text')} END AS v FROM near_lines),
spot AS (SELECT doc_id, page_no, field, {_clean_valid("'lugar_nacimiento'", 'p')} AS v FROM (SELECT doc_id, page_no, field, string_agg(text, ' ' ORDER BY dist) AS p
  FROM (SELECT * FROM near_lines WHERE field = 'lugar_nacimiento' AND dist < 0 AND is_plain AND {parse_date('text')} IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, field ORDER BY dist DESC) <= 2) GROUP BY ALL)),
val AS MATERIALIZED (SELECT doc_id, page_no, field, coalesce(any_value(spot.v), arg_min(said.v, abs(dist)) FILTER (WHERE said.v IS NOT NULL)) AS value FROM said LEFT JOIN spot USING (doc_id, page_no, field) GROUP BY ALL)"""


_E = f"e AS ({X.EXTRACTIONS_SQL}), u AS ({X.USERS_SQL}), s AS ({X.STUDENTS_SQL}), p AS ({X.PROGRAMS_SQL}), x AS (SELECT *, nullif({strip('numero_documento')}, '') AS number FROM e WHERE usuario_id IN (SELECT Id FROM u) AND programa IS NOT NULL)"
_FILL = {"nombre_completo": "NombreCompleto", "fecha_nacimiento": "FechaNacimiento", "sexo": "Sexo", "lugar_nacimiento": "LugarNacimiento", "nacionalidad": "Nacionalidad", "tipo_sangre": "TipoSangre"}
STUDENTS = f"""{_E}, fold AS (SELECT number, min(arrival_seq) AS seq, {', '.join(f"arg_max({a}, arrival_seq) FILTER (WHERE nullif({a}, '') IS NOT NULL) AS f_{b}" for a, b in _FILL.items())}, arg_max(programa, arrival_seq) AS prog, arg_min(usuario_id, arrival_seq) AS usr FROM x WHERE number IS NOT NULL GROUP BY number),
k AS (SELECT NumeroDocumento AS number, min(Id) AS sid FROM s WHERE NumeroDocumento IS NOT NULL GROUP BY 1),
old AS (SELECT s.Id, s.NumeroDocumento, {', '.join(f"coalesce(f.f_{b}, s.{b}) AS {b}" for b in _FILL.values())}, CASE WHEN f.number IS NOT NULL THEN f.prog ELSE s.Programa END AS Programa, s.UsuarioId
  FROM s LEFT JOIN k ON s.Id = k.sid LEFT JOIN fold f ON f.number = k.number),
fresh AS (SELECT seq, number AS NumeroDocumento, {', '.join(f"coalesce(f_{b}, '') AS {b}" for b in _FILL.values())}, prog AS Programa, usr AS UsuarioId FROM fold WHERE number NOT IN (SELECT number FROM k)
  UNION ALL SELECT arrival_seq, NULL, {', '.join(f"coalesce({a}, '')" for a in _FILL)}, programa, usuario_id FROM x WHERE number IS NULL),
after_s AS (SELECT * FROM old UNION ALL SELECT CAST((SELECT coalesce(max(Id), 0) FROM s) + row_number() OVER (ORDER BY seq) AS INTEGER), NumeroDocumento, {', '.join(_FILL.values())}, Programa, UsuarioId FROM fresh)"""
PROGRAMS = f"{_E}, np AS (SELECT programa, min(arrival_seq) AS seq FROM x WHERE programa NOT IN (SELECT nombre FROM p) GROUP BY 1), after_p AS (SELECT id, nombre FROM p UNION ALL SELECT CAST((SELECT max(id) FROM p) + row_number() OVER (ORDER BY seq) AS INTEGER), programa FROM np)"
DOCUMENTS = f"""WITH {STUDENTS}, {PROGRAMS.split('), np AS', 1)[1].join(['np AS', ''])},
nulls AS (SELECT arrival_seq, row_number() OVER (ORDER BY arrival_seq DESC) AS r FROM x WHERE number IS NULL), ns AS (SELECT Id, row_number() OVER (ORDER BY Id DESC) AS r FROM after_s WHERE NumeroDocumento IS NULL)
SELECT CAST(row_number() OVER (ORDER BY x.arrival_seq) AS INTEGER) AS Id, coalesce(k2.sid, ns.Id) AS EstudianteId, pr.id AS ProgramaId, x.usuario_id AS UsuarioId, 'Cedula' AS TipoDocumento, x.archivo AS Archivo
FROM x LEFT JOIN (SELECT NumeroDocumento AS number, min(Id) AS sid FROM after_s WHERE NumeroDocumento IS NOT NULL GROUP BY 1) k2 USING (number)
LEFT JOIN nulls USING (arrival_seq) LEFT JOIN ns USING (r) JOIN (SELECT nombre, min(id) AS id FROM after_p GROUP BY 1) pr ON pr.nombre = x.programa"""

_PAGES = """pg AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 2 + 1 AS INTEGER) AS page_no, CASE WHEN o_orderkey % 3 = 0 THEN 'digital' ELSE 'hologramas' END AS modelo,
  o_orderkey % 2000 + 1 AS width, o_orderkey % 1300 + 1 AS height FROM orders),
tp AS (SELECT *, CASE WHEN modelo = 'digital' THEN 'digital' WHEN page_no = 1 THEN 'anverso' ELSE 'reverso' END AS template FROM pg)"""
_ZONES = "z(template, field, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{t}', '{f}', " + ", ".join(f"{v}::DOUBLE" for v in box) + ")" for t, zs in ZONES.items() for f, box in zs.items()) + ")"
_QUADS = """q AS (SELECT o_orderkey AS doc_id, CAST(300 + o_orderkey % 90 AS DOUBLE) AS w, CAST(200 + o_orderkey % 40 AS DOUBLE) AS h FROM orders),
p AS (SELECT doc_id, [[w, h + doc_id % 7], [10 + doc_id % 5, 12], [w + doc_id % 11, 15 + doc_id % 3], [8 + doc_id % 4, h]] AS p FROM q),
k AS (SELECT doc_id, p, list_transform(p, lambda c: c[1] + c[2]) AS s, list_transform(p, lambda c: c[2] - c[1]) AS d FROM p),
c AS (SELECT doc_id, p[list_position(s, list_min(s))] AS tl, p[list_position(d, list_min(d))] AS tr, p[list_position(s, list_max(s))] AS br, p[list_position(d, list_max(d))] AS bl FROM k)"""
_SIDE = lambda a, b: f"sqrt(pow({a}[1] - {b}[1], 2) + pow({a}[2] - {b}[2], 2))"



_SEVEN = [f"CASE WHEN doc_id % {m} = 0 THEN {c}_raw END" for m, c in ((2, "number"), (3, "text"), (5, "text"), (7, "text"), (11, "date"), (13, "sex"), (4, "blood"))]


def _after(label: str, more: str = "") -> str:
    found = rf"nullif(regexp_extract(text, '(?i){label}\s*\n([A-ZÁÉÍÓÚÑ\s{more}]+)', 1), '')"
    return f"coalesce({clean_text(found)}, '')"


def _found(p: str, g: int = 0, x: str = "text") -> str:
    return f"nullif(regexp_extract({x}, '{p}', {g}), '')"


def _reading(n: int) -> str:
    """A zone's reading by its field, null for none and for blanks."""
    case = " ".join(f"WHEN {w} THEN {X.sql_pick(cases, f'doc_id + {n}', 'doc_id')}" for w, cases in ((0, X.NUMBERS), (4, X.DATES), (5, X.SEXES), (8, X.BLOODS)))
    value = f"CASE w {case} ELSE {X.sql_pick(X.TEXTS, f'doc_id + {n}', 'doc_id')} END"
    return f"CASE WHEN (doc_id + w) % {n} > 0 THEN nullif({strip(value)}, '') END"


def _card(area: str) -> str:
    """The score of corners tl, tr, br, bl on an image of 900 by 700, null for none."""
    w, h = f"(({_SIDE('tr', 'tl')} + {_SIDE('br', 'bl')}) / 2)", f"(({_SIDE('bl', 'tl')} + {_SIDE('br', 'tr')}) / 2)"
    card, share = "(85.60::DOUBLE / 53.98)", f"({area} / (900.0::DOUBLE * 700))"
    points = f"least({share} / 0.25, 1) * 0.35 + greatest(0, 1 - abs({w} / {h} - {card}) / {card} / 0.35) * 0.40 + least({area} / greatest({w} * {h}, 1) / 0.90, 1) * 0.25"
    return f"CASE WHEN {share} >= 0.02 AND {w} / {h} BETWEEN 1.15 AND 2.10 THEN {points} END"


_TURNS = ", ".join(f"(p[{(i + 1) % 4 + 1}][1] - p[{i + 1}][1]) * (p[{(i + 2) % 4 + 1}][2] - p[{(i + 1) % 4 + 1}][2]) - (p[{(i + 1) % 4 + 1}][2] - p[{i + 1}][2]) * (p[{(i + 2) % 4 + 1}][1] - p[{(i + 1) % 4 + 1}][1])" for i in range(4))
_CHOSEN = f"""im AS (SELECT o_orderkey AS k, o, CAST(180 + o_orderkey % 97 * 3 + o * 40 AS DOUBLE) AS w, CAST(150 + o_orderkey % 83 * 2 + o * 10 AS DOUBLE) AS h FROM orders, (VALUES (0), (1)) AS v(o)),
co AS (SELECT *, [5.0 + k % 3, 7.0]::DOUBLE[] AS a, [w, 4.0 + k % 6]::DOUBLE[] AS b, [w + k % 5, h]::DOUBLE[] AS c, [2.0, h + k % 4]::DOUBLE[] AS d FROM im),
qu AS (SELECT k, o, w * h * 0.93::DOUBLE AS area, CASE WHEN (k + o) % 5 = 0 THEN [a, c, b, d] ELSE [a, b, c, d] END AS p FROM co WHERE k % 4 > 0),
cv AS (SELECT *, list_transform(p, lambda x: x[1] + x[2]) AS s, list_transform(p, lambda x: x[2] - x[1]) AS df FROM qu WHERE list_min([{_TURNS}]) >= 0 OR list_max([{_TURNS}]) <= 0),
cr AS (SELECT *, p[list_position(s, list_min(s))] AS tl, p[list_position(df, list_min(df))] AS tr, p[list_position(s, list_max(s))] AS br, p[list_position(df, list_max(df))] AS bl FROM cv),
sc AS (SELECT *, {_card('area')} AS score, ({_SIDE('tr', 'tl')} + {_SIDE('br', 'bl')}) / ({_SIDE('bl', 'tl')} + {_SIDE('br', 'tr')}) AS aspect FROM cr),
qb AS (SELECT * FROM sc WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, o) = 1),
rg AS (SELECT k, o, w * h * 0.8::DOUBLE / 630000.0::DOUBLE AS share, CAST(k % 50 AS INTEGER) AS x, CAST(k % 30 * 20 AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM im WHERE k % 3 > 0),
rb AS (SELECT *, least(share / 0.5, 1) AS score, greatest(0, x - 7) AS l, greatest(0, y - 7) AS t FROM rg WHERE share >= 0.05 AND w / greatest(h, 1) BETWEEN 1.10 AND 2.20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY least(share / 0.5, 1) DESC, o) = 1),
ch AS (SELECT o_orderkey AS doc_id, coalesce(qb.score >= 0.45, false) AS quad, rb.k IS NOT NULL AS region, qb.score AS qs, rb.score AS rs, qb.aspect, qb.tl, qb.br, l, t, rb.w, rb.h FROM orders LEFT JOIN qb ON qb.k = o_orderkey LEFT JOIN rb ON rb.k = o_orderkey)"""

ORACLES = {
    "t01_normalize": over_raw(f"{normal('text_raw')} AS norm"),
    "t02_upper_plain": over_raw(f"{upper_plain('text_raw')} AS plain"),
    "t03_number": over_raw(f"{digits('number_raw')} AS number, coalesce({digits('number_raw')}, '') AS number_or_empty"),
    "t04_text": over_raw(f"{clean_text('text_raw')} AS clean, coalesce({clean_text('text_raw')}, '') AS clean_or_empty, CASE WHEN text_raw <> '' THEN trim(regexp_replace(text_raw, '[^A-Za-zÁÉÍÓÚÑ ]', '', 'g')) END AS clean_upper"),
    "t05_date": over_raw(f"{parse_date('date_raw')} AS iso, {lenient('date_raw')} AS lenient, nullif(regexp_extract(date_raw, '[0-9]{{2}}[-/][A-Za-z]{{3}}[-/][0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}', 0), '') AS found"),
    "t06_sex": over_raw(f"{sex('sex_raw')} AS sex, coalesce({sex('sex_raw')}, '') AS sex_or_empty"),
    "t07_blood": over_raw(f"{blood('blood_raw')} AS blood, coalesce(regexp_extract(upper(blood_raw), '^([ABO]{{1,2}}[+-])', 1), '') AS blood_prefix"),
    "t08_valid": f"WITH {_C} SELECT doc_id, page_no, field, source, {valid('field', 'value')} AS ok FROM c",
    "t09_clean_field": f"WITH {_C}, k AS (SELECT *, {cleaned('field', 'value')} AS v FROM c) SELECT doc_id, page_no, field, source, CASE WHEN {valid('field', 'v')} THEN v END AS clean FROM k",
    "t10_similarity": f"WITH RECURSIVE raw AS MATERIALIZED (SELECT doc_id, {normal('text_raw')} AS tn FROM ({X.RAW_SQL})), {table_of('lab', LABELS)}, {ratios('SELECT tn AS a, xn AS b FROM (SELECT DISTINCT tn FROM raw), lab')} SELECT doc_id, x AS label, s AS similarity FROM raw CROSS JOIN lab JOIN ratio ON a = tn AND b = xn",
    "t11_age": over_raw(f"{age('date_raw')} AS age"),
    "t12_document_type": over_raw("CASE WHEN regexp_full_match(coalesce(number_raw, ''), '[0-9]{8,10}') THEN 'colombia_cedula' WHEN regexp_full_match(coalesce(number_raw, ''), '[0-9]{6,8}') THEN 'colombia_tarjeta' WHEN regexp_full_match(coalesce(number_raw, ''), '[0-9]{7,9}') THEN 'venezuela' ELSE 'extranjero' END AS kind"),
    "t13_checks": over_raw("regexp_full_match(coalesce(text_raw, ''), '[A-Za-zÁÉÍÓÚÑ ]+') AS name_ok, regexp_full_match(coalesce(number_raw, ''), '[0-9]{8,10}') AS number_ok, upper(coalesce(sex_raw, '')) IN ('M', 'F') AS sex_ok, regexp_full_match(coalesce(blood_raw, ''), '(A|B|O)[+-]') AS blood_ok"),
    "t14_useful": over_raw(f"{filled('number_raw', 'text_raw', 'date_raw', 'sex_raw', 'blood_raw')} >= 2 AS useful, CAST({filled('number_raw', 'text_raw', 'date_raw', 'sex_raw', 'blood_raw')} AS INTEGER) AS filled"),
    "t14b_useful_seven": over_raw(f"{filled(*_SEVEN)} >= 2 AS useful, CAST({filled(*_SEVEN)} AS INTEGER) AS filled"),
    "t15_final": over_raw(f"coalesce({strip('text_raw')}, '') AS name, coalesce({strip('number_raw')}, '') AS number"),
    "t16_score": f"WITH {_C} SELECT doc_id, page_no, field, source, CAST({score('field', 'value', 10)} AS INTEGER) AS by_label, CAST({score('field', 'value', 0)} AS INTEGER) AS by_zone FROM c",
    "t17_defaults": over_raw(f"coalesce(nullif('', ''), blood_raw) AS tipo_sangre, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN text_raw END, ''), {strip("coalesce(" + strip('text_raw') + ", '') || ' ' || coalesce(" + strip('number_raw') + ", '')")}) AS nombre_completo"),
    "x01_lines": f"WITH {LINES} SELECT doc_id, line_no, raw FROM lines",
    "x01_document_lines": "WITH cut AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> '')) SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS raw FROM cut",
    "x02_header_trim": f"WITH {TRIMMED} SELECT doc_id, line_no, raw FROM body",
    "x03_doc_state": f"WITH {CONTEXT} SELECT doc_id, line_no, kind FROM ctx",
    "x04_lookahead": f"WITH {CONTEXT} SELECT doc_id, line_no, {WRITES['numero_documento']} AS number, {WRITES['fecha_nacimiento']} AS birth, {WRITES['sexo']} AS sex FROM ctx",
    "x05_lookbehind": f"WITH {CONTEXT} SELECT doc_id, line_no, {WRITES['lugar_nacimiento']} AS place, {WRITES['fecha_expedicion']} AS issued, {WRITES['rh']} AS rh FROM ctx",
    "x06_names": f"WITH {CONTEXT} SELECT doc_id, line_no, {WRITES['nombre_completo']} AS name FROM ctx",
    "x08_new_extras": f"WITH {CONTEXT} SELECT doc_id, line_no, {WRITES['nacionalidad']} AS nationality FROM ctx",
    "x09_last_write": f"WITH {CONTEXT} SELECT doc_id, {FOLDED} FROM ctx GROUP BY doc_id",
    "x10_number_fallback": f"SELECT doc_id, {NUMBER} AS number FROM ({X.CARD_SQL})",
    "x11_name_fallback": f"SELECT doc_id, nullif({NAME}, '') AS name FROM ({X.CARD_SQL})",
    "x12_extract_by_lines": BY_LINES,
    "x13_extract_regex": f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in PATTERNS.items())} FROM ({X.CARD_SQL})",
    "x14_extract_hybrid": f"""SELECT doc_id, coalesce({digits(_found('[0-9]{6,15}'))}, '') AS numero_documento, coalesce({lenient(_found('[0-9]{2}-[A-Z]{3}-[0-9]{4}'))}, '') AS fecha_nacimiento,
      coalesce(regexp_extract(upper({_found('(O|A|B|AB)[+-]')}), '^([ABO]{{1,2}}[+-])', 1), '') AS tipo_sangre, coalesce({sex(_found(f'(^|[^{WORD}])([MF])($|[^{WORD}])', 2, 'upper(text)'))}, '') AS sexo,
      {_after('APELLIDOS')} AS apellidos, {_after('NOMBRES')} AS nombres, trim({_after('NOMBRES')} || ' ' || {_after('APELLIDOS')}) AS nombre_completo,
      {_after('LUGAR DE NACIMIENTO', '()')} AS lugar_nacimiento, {_after('NACIONALIDAD')} AS nacionalidad FROM ({X.CARD_SQL})""",
    "x15_wider_fallbacks": WIDER,
    "l01_word_dedupe": f"WITH {WORDS} SELECT doc_id, page_no, config_ord, word_ord, text, norm, x, y, w, h, cx, cy, conf FROM d",
    "l02_line_clustering": f"WITH RECURSIVE {CLUSTERED} SELECT doc_id, page_no, config_ord, word_ord, line_id FROM b",
    "l03_line_assembly": f"WITH RECURSIVE {LINED} SELECT * EXCLUDE (letters) FROM n",
    "l04_find_labels": f"WITH RECURSIVE {FOUND} SELECT doc_id, page_no, field, line_no, label, score FROM found",
    "l05_neighbours": f"WITH RECURSIVE {LINED} SELECT doc_id, page_no, line_no, coalesce(array_to_string(list(text) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS above, coalesce(array_to_string(list(text) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS below FROM n",
    "l06_extract_by_labels": f"WITH RECURSIVE {LABELLED} SELECT doc_id, page_no, field, value FROM found LEFT JOIN val USING (doc_id, page_no, field)",
    "l07_resembles_label": f"WITH RECURSIVE {FOUND} SELECT doc_id, page_no, line_no, is_label FROM n JOIN islab USING (norm)",
    "l08_detect_side": f"WITH RECURSIVE {LINED}, {SIDE_PART} SELECT * FROM side",
    "l09_by_labels": f"""WITH RECURSIVE {LABELLED}, {SIDE_PART}, want AS (SELECT doc_id, page_no, lado, unnest(CASE lado {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SIDE_FIELDS.items())} END) AS field FROM side),
      got AS (SELECT doc_id, page_no, lado, field, {cleaned('field', 'value')} AS v FROM want LEFT JOIN val USING (doc_id, page_no, field)) SELECT doc_id, page_no, lado, field, CASE WHEN {valid('field', 'v')} THEN v END AS value FROM got""",
    "l10_zone_boxes": f"""WITH {_PAGES}, {_ZONES}, b AS (SELECT doc_id, page_no, template, field, CAST(trunc(x1 * width) AS INTEGER) AS "left", CAST(trunc(y1 * height) AS INTEGER) AS top,
      CAST(trunc(x2 * width) AS INTEGER) AS "right", CAST(trunc(y2 * height) AS INTEGER) AS bottom FROM tp JOIN z USING (template)) SELECT * FROM b WHERE "right" > "left" AND bottom > top""",
    "l11_template": f"WITH {_PAGES} SELECT doc_id, page_no, template FROM tp",
    "l12_line_text": f"WITH RECURSIVE {CLUSTERED}, t AS (SELECT doc_id, page_no, line_id, string_agg(text, ' ' ORDER BY x, text) AS text, (min(y) + max(y + h)) / 2 AS cy FROM b GROUP BY ALL) SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY cy, line_id) - 1 AS INTEGER) AS line_no, text FROM t",
    "l13_zone_values": f"""WITH {_PAGES}, {_ZONES}, z0 AS (SELECT doc_id, page_no, template, field, list_position({FIELDS}, field) - 1 AS w FROM tp JOIN z USING (template)
        WHERE trunc(x2 * width) > trunc(x1 * width) AND trunc(y2 * height) > trunc(y1 * height)),
      rd AS (SELECT *, coalesce({_reading(3)}, {_reading(4)}) AS raw FROM z0), cl AS (SELECT *, {cleaned('field', 'raw')} AS v FROM rd)
      SELECT doc_id, page_no, template, field, CASE WHEN {valid('field', 'v')} THEN v END AS value FROM cl""",
    "v01_order_corners": f"WITH {_QUADS} SELECT doc_id, tl[1] AS tl_x, tl[2] AS tl_y, tr[1] AS tr_x, tr[2] AS tr_y, br[1] AS br_x, br[2] AS br_y, bl[1] AS bl_x, bl[2] AS bl_y FROM c",
    "v02_card_score": f"""WITH {_QUADS}, m AS (SELECT doc_id, (290.0 + doc_id % 90)::DOUBLE * (180.0 + doc_id % 40)::DOUBLE AS area, ({_SIDE('tr', 'tl')} + {_SIDE('br', 'bl')}) / 2 AS w, ({_SIDE('bl', 'tl')} + {_SIDE('br', 'tr')}) / 2 AS h FROM c),
      a AS (SELECT *, w / h AS aspect, area / (900.0::DOUBLE * 700) AS share, 85.60::DOUBLE / 53.98 AS card FROM m)
      SELECT doc_id, CASE WHEN share >= 0.02 AND aspect BETWEEN 1.15 AND 2.10 THEN round(least(share / 0.25, 1) * 0.35 + greatest(0, 1 - abs(aspect - card) / card / 0.35) * 0.40 + least(area / greatest(w * h, 1) / 0.90, 1) * 0.25, 9) END AS score FROM a""",
    "v04_choose_card": f"""WITH {_CHOSEN} SELECT doc_id, quad OR region AS detected, CASE WHEN quad THEN 'quadrilateral' WHEN region THEN 'bounding_box_fallback' ELSE 'original_image' END AS method,
      CASE WHEN quad THEN round(qs, 4) WHEN region THEN round(rs, 4) ELSE 0 END AS score, CASE WHEN quad THEN round(aspect, 4) END AS aspect, CASE WHEN quad THEN round(tl[1], 2) END AS tl_x, CASE WHEN quad THEN round(br[2], 2) END AS br_y,
      CASE WHEN quad THEN NULL WHEN region THEN l ELSE 0 END AS x1, CASE WHEN quad THEN NULL WHEN region THEN t ELSE 0 END AS y1,
      CASE WHEN quad THEN NULL WHEN region THEN least(900, l + w + 14) ELSE 900 END AS x2, CASE WHEN quad THEN NULL WHEN region THEN least(700, t + h + 14) ELSE 700 END AS y2 FROM ch""",
    "r01_text_merge": f"WITH {MERGED} SELECT * FROM t",
    "r02_general_accumulate": f"WITH {MERGED} SELECT * FROM g",
    "r03_crop_accumulate": f"WITH {MERGED} SELECT * FROM z",
    "r04_compare": f"WITH {COMPARED}",
    "r05_field_union": f"WITH {_C} SELECT DISTINCT doc_id, field FROM c WHERE source <> 'text'",
    "r06_precedence": f"WITH {MERGED} SELECT doc_id, field, coalesce(g.value, z.value, t.value) AS value FROM g FULL JOIN z USING (doc_id, field) FULL JOIN t USING (doc_id, field)",
    "r07_full_name": f"""WITH {MERGED}, m AS (SELECT doc_id, max(value) FILTER (WHERE field = 'lugar_nacimiento') AS a, max(value) FILTER (WHERE field = 'nombres') AS n FROM z GROUP BY doc_id),
      full_name AS (SELECT doc_id, 'nombre_completo' AS field, {clean_text("(a || ' ' || n)")} AS value FROM m WHERE a IS NOT NULL AND n IS NOT NULL) SELECT * FROM full_name WHERE length(value) >= 3
      UNION ALL SELECT doc_id, CASE WHEN field = 'lugar_nacimiento' THEN 'apellidos' ELSE field END, value FROM z""",
    "r08_combine": f"""WITH {LATEST}, k AS MATERIALIZED (SELECT doc_id, field, general AS e, crop AS z, {score('field', 'general', 10)} AS es, {score('field', 'crop', 0)} AS zs FROM j),
      q AS (SELECT *, CASE WHEN coalesce(z, '') = '' AND coalesce(e, '') <> '' THEN true WHEN coalesce(e, '') = '' AND coalesce(z, '') <> '' THEN false ELSE es > zs END AS lab FROM k)
      SELECT doc_id, field, CASE WHEN lab THEN e ELSE z END AS value, CASE WHEN lab THEN 'ETIQUETA' ELSE 'COORDENADAS' END AS origen FROM q""",
    "r09_envelope": f"""{BY_LINES.replace('WITH ', 'WITH ' + MERGED.replace('k AS MAT', 'kc AS MAT').replace('FROM k WHERE', 'FROM kc WHERE').replace('g AS MAT', 'ge AS MAT').replace('t AS MAT', 'te AS MAT') + ', ', 1).replace('SELECT p.doc_id, coalesce', ', tx AS (SELECT p.doc_id, coalesce')}),
      ok AS (SELECT *, {filled('numero_documento', 'nombre_completo', 'fecha_nacimiento', 'sexo', 'rh')} >= 2 AS ok FROM tx),
      oc AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM te UNION ALL SELECT doc_id FROM ge UNION ALL SELECT doc_id FROM z))
      SELECT doc_id, CASE WHEN ok THEN 'pdf_texto' WHEN oc.doc_id IS NOT NULL THEN 'ocr_template' END AS metodo, CASE WHEN NOT coalesce(ok, false) AND oc.doc_id IS NULL THEN 'El documento no se pudo leer correctamente.' END AS error,
      CASE WHEN ok THEN CAST({' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in ('nombre_completo', 'numero_documento', 'fecha_nacimiento', 'sexo', 'lugar_nacimiento', 'fecha_expedicion', 'nacionalidad', 'rh', 'edad'))} AS INTEGER)
        WHEN oc.doc_id IS NOT NULL THEN 9 ELSE 0 END AS n_fields FROM ok FULL JOIN oc USING (doc_id)""",
    "m01_student_upsert": f"WITH {STUDENTS} SELECT * FROM after_s",
    "m02_program_get_or_create": f"WITH {PROGRAMS} SELECT * FROM after_p",
    "m03_document_append": DOCUMENTS,
    "m04_user_gate": f"WITH {_E} SELECT arrival_seq, usuario_id, usuario_id IN (SELECT Id FROM u) AS known FROM e",
    "m05_register_unique": f"""WITH u AS ({X.USERS_SQL}), r AS (SELECT o_orderkey AS seq, 'user' || o_orderkey // 2 || '@example.org' AS Email, 'N' || o_orderkey AS Nombre FROM orders),
      f AS (SELECT Email, min(seq) AS seq, arg_min(Nombre, seq) AS Nombre FROM r WHERE Email NOT IN (SELECT Email FROM u) GROUP BY 1)
      SELECT CAST((SELECT max(Id) FROM u) + row_number() OVER (ORDER BY seq) AS INTEGER) AS Id, Email, Nombre, CAST(0 AS INTEGER) AS ConteoIngresos FROM f""",
    "m06_login_counter": f"""WITH u AS ({X.USERS_SQL}), l AS (SELECT 'user' || user_id || '@example.org' AS Email, count(*) FILTER (WHERE event_id % 5 > 0) AS n FROM events GROUP BY 1)
      SELECT u.Id, u.Email, CAST(CASE WHEN coalesce(n, 0) = 0 THEN ConteoIngresos ELSE coalesce(ConteoIngresos, 0) + n END AS INTEGER) AS ConteoIngresos FROM u LEFT JOIN l USING (Email)""",
    "snk2_verify_append": f"WITH done AS ({DOCUMENTS}) SELECT Id, Id % 100 > 0 AS stored, true AS student, true AS program, true AS \"user\" FROM done",
    "m07_store_students": f"WITH {STUDENTS} SELECT * FROM after_s",
    "m07_store_documents": f"WITH done AS ({DOCUMENTS}), {STUDENTS}, {PROGRAMS.split('), np AS', 1)[1].join(['np AS', ''])} SELECT done.*, a.NumeroDocumento, b.nombre AS Programa FROM done JOIN after_s a ON a.Id = EstudianteId JOIN after_p b ON b.id = ProgramaId",
    "m07_store_rejected": f"WITH {_E} SELECT arrival_seq, usuario_id, programa, CASE WHEN usuario_id IN (SELECT Id FROM u) THEN 'programa' ELSE 'usuario' END AS reason FROM e WHERE usuario_id NOT IN (SELECT Id FROM u) OR programa IS NULL",
    "src05_lookup": f"SELECT Id, NumeroDocumento FROM ({X.STUDENTS_SQL}) WHERE NumeroDocumento = '20000013' ORDER BY Id LIMIT 1",
    "src06_literal_sql": f"SELECT Id, Email, ConteoIngresos FROM ({X.USERS_SQL}) ORDER BY Id LIMIT 1",
    "src01_joined_text": f"SELECT doc_id, string_agg(text || chr(10), '' ORDER BY page_no) AS text FROM (SELECT * FROM ({X.CARD_SQL}) UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 > 0 THEN 'page two ' || doc_id ELSE '  ' END FROM ({X.CARD_SQL})) WHERE {strip('text')} <> '' GROUP BY doc_id",
    "src02_first_pages": f"SELECT DISTINCT doc_id, page_no FROM ({X.CANDIDATES_SQL}) WHERE page_no <= 2",
    "src03_usable_words": f"WITH {WORDS} SELECT doc_id, page_no, config_ord, word_ord, text, norm, cx, cy FROM w",
    "src05_first_student": f"WITH s AS ({X.STUDENTS_SQL}) SELECT arg_min(Id, Id) AS Id, NumeroDocumento FROM s WHERE NumeroDocumento IS NOT NULL GROUP BY NumeroDocumento",
    "snk1_landing_path": f"SELECT arrival_seq, 'documentos/' || replace(programa, ' ', '_') || '/' || usuario_id || '_20240301_101112_' || archivo AS path FROM ({X.EXTRACTIONS_SQL})",
    "snk3_crop_url": f"SELECT arrival_seq, 'https://example.org/ocr/debug/' || programa || '/ocr_debug/pagina_01_nombres.png' AS url FROM ({X.EXTRACTIONS_SQL})",
}
ORACLES |= {"m05_register_stream": ORACLES["m05_register_unique"], "m06_login_stream": ORACLES["m06_login_counter"]}
_LANDED = "SELECT ['Sistemas', 'Cocina_fria', 'Redes'][CAST(page_id % 3 AS INTEGER) + 1] AS folder, page_id || '_20240301_101112_page ' || page_id AS name, coalesce(html, '') AS html FROM pages"
ORACLES |= {
    "snk1_landed_files": f"SELECT folder, name, CAST(octet_length(encode(html)) AS BIGINT) AS length, sha256(replace(html, chr(10), chr(12))) AS sha256 FROM ({_LANDED})",
    "src02_page_source": f"SELECT folder || '/' || name AS doc_id, CAST(page_no AS INTEGER) AS page_no, text, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, unnest(string_split(html, chr(10))) AS text, generate_subscripts(string_split(html, chr(10)), 1) AS page_no FROM ({_LANDED})) WHERE page_no <= 2",
}
ORACLES["t10_similar_pairs"] = f"WITH RECURSIVE {FOUND.split('best AS MATERIALIZED', 1)[0].rstrip(', ' + chr(10))} SELECT DISTINCT a AS text, b AS label, s AS similarity FROM ratio WHERE s >= 0.62"


def _taps(window: int, value: str, line: str, along: str) -> str:
    """The sum of weighted neighbours along a line, whose ends go on."""
    half, sigma = window // 2, 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    bell = [math.exp(-((i - half) ** 2) / (2 * sigma**2)) for i in range(window)]
    whole = [math.floor(b / sum(bell) * 65_536 + 0.5) for b in bell]
    whole[half] += 65_536 - sum(whole)
    over = f"OVER (PARTITION BY image_id, {line} ORDER BY {along})"
    ends = f"OVER (PARTITION BY image_id, {line} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    near = lambda i: value if i == half else f"coalesce(lag({value}, {half - i}) {over}, first_value({value}) {ends})" if i < half else f"coalesce(lead({value}, {i - half}) {over}, last_value({value}) {ends})"
    return " + ".join(f"{w}::BIGINT * {near(i)}" for i, w in enumerate(whole))


ORACLES["v07_text_threshold"] = f"""WITH b AS (SELECT doc_id AS image_id, hex(encode(coalesce(text, ''))) AS b FROM documents), r AS (SELECT image_id, greatest(1, (length(b) // 2 + 23) // 24)::INTEGER AS height, b FROM b),
px AS (SELECT image_id, height, unnest(list_resize(regexp_extract_all(b, '..'), height * 24, '00')) AS byte, unnest(range(height * 24)) AS i FROM r),
spot AS (SELECT image_id, height, i, i // 24 AS y, i % 24 AS x, ('0x' || byte)::INTEGER AS v FROM px),
across AS (SELECT *, {_taps(11, "v", "y", "x")} AS s FROM spot), both_ways AS (SELECT *, {_taps(11, "s", "x", "y")} AS t FROM across)
SELECT image_id, 24 AS width, height, sha256(unhex(string_agg(CASE WHEN v > (t + 2147483648) // 4294967296 - 2 THEN 'FF' ELSE '00' END, '' ORDER BY i))) AS sha256, CAST(NULL AS VARCHAR) AS error FROM both_ways GROUP BY image_id, height"""
ORACLES["src05_store_lookup"] = ORACLES["src05_lookup"]
_TEXT_FIELDS = ("nombre_completo", "numero_documento", "fecha_nacimiento", "sexo", "lugar_nacimiento", "fecha_expedicion", "nacionalidad", "rh", "edad")
_OCR_FIELDS = ("numero_documento", "nombre_completo", "apellidos", "nombres", "fecha_nacimiento", "sexo", "lugar_nacimiento", "nacionalidad", "tipo_sangre")
ORACLES["r09_values"] = f"""{ORACLES["r09_envelope"].rsplit("SELECT doc_id, CASE WHEN ok", 1)[0]}
SELECT doc_id, 'pdf_texto' AS metodo, v.f AS field, v.v AS value FROM (SELECT doc_id, unnest([{", ".join(f"{{'f': '{f}', 'v': {f}::VARCHAR}}" for f in _TEXT_FIELDS)}]) AS v FROM ok WHERE ok) WHERE v.v IS NOT NULL
UNION ALL
SELECT d.doc_id, 'ocr_template', d.field, coalesce({strip('x.value')}, '') FROM (SELECT doc_id, unnest([{", ".join(f"'{f}'" for f in _OCR_FIELDS)}]) AS field FROM oc LEFT JOIN ok USING (doc_id) WHERE NOT coalesce(ok, false)) d
LEFT JOIN (SELECT doc_id, field, coalesce(ge.value, z.value, te.value) AS value FROM ge FULL JOIN z USING (doc_id, field) FULL JOIN te USING (doc_id, field)) x USING (doc_id, field)"""
