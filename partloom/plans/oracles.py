"""The queries as plain SQL, written on their own for another engine's dialect; the tests and the driver compare."""

from __future__ import annotations

from ..functions import knowledge as K
from .adapters import LINES, PRESET_KEYS, PROJECTS, STOCK, VALUES

TOKEN = r"^([a-zA-Z0-9_\-]+)[\s,]+([0-9a-zA-Z./\-]+)"
RANGE = r"^([A-Z]+)([0-9]+)-[A-Z]*([0-9]+)"
SANDWICH = "^([0-9]+)([pnuµmkKMG])([0-9]+)"
PLAIN = r"^([0-9.]+)\s*([pnuµmkKMG])?"
KEY = r"^\[(.*?)\] (?:\[(.*?)\] )?(.*)$"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def unit(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN CAST({v!r} AS DOUBLE)" for k, v in K.SI.items()) + " ELSE 1.0::DOUBLE END"


def parse(x: str) -> str:
    part = lambda p, i: f"regexp_extract({x}, '{p}', {i})"
    return f"""CASE WHEN regexp_matches({x}, '{SANDWICH}')
        THEN TRY_CAST({part(SANDWICH, 1)} || '.' || {part(SANDWICH, 3)} AS DOUBLE) * {unit(part(SANDWICH, 2))}
        ELSE TRY_CAST({part(PLAIN, 1)} AS DOUBLE) * {unit(part(PLAIN, 2))} END"""


def form(v: str) -> str:
    """Search form of a number; large expressions are bound once by a one-row subquery."""
    def scaled(u: str) -> str:
        r = f"round({v} / {K.SI[u]!r}, 6)"
        return f"CASE WHEN {r} = floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {r}) END || '{u}'"

    cases = "".join(f" WHEN {v} >= {K.SI[u]!r} THEN {scaled(u)}" for u in ("M", "k"))
    cases += "".join(f" WHEN {v} < 1 AND {v} >= {K.SI[u]!r} THEN {scaled(u)}" for u in ("u", "n", "p"))
    r = f"round({v}, 6)"
    return f"CASE WHEN {v} IS NULL THEN ''{cases} WHEN {r} = floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) ELSE CAST({r} AS VARCHAR) END"


def any_of(words) -> str:
    import re

    return "|".join(re.escape(w).replace("\\ ", " ") for w in words).replace("'", "''")


def starts(x: str, words) -> str:
    return f"regexp_matches({x}, '^(?:{any_of(words)})')"


def category(r: str, v: str) -> str:
    tapers = "".join(K.TAPERS)
    pot = f"({starts(r, K.POT_LABELS)} OR (NOT {starts(r, ['IC', 'U', 'Q', 'OP', 'TL'])} AND regexp_matches({v}, '[0-9].*[{tapers}]$|^[{tapers}][0-9]')))"
    switch = f"{r} IN ({', '.join(map(q, K.SWITCH_LABELS))})"
    return f"""CASE
        WHEN NOT (({starts(r, K.CLASSIFIER_PREFIXES)} AND regexp_matches({r}, '[0-9]')) OR {pot} OR {switch} OR {r} = 'CLR') THEN NULL
        WHEN starts_with({r}, 'LDR') THEN 'Optoelectronics'
        WHEN {pot} THEN 'Potentiometers'
        WHEN {switch} THEN CASE WHEN regexp_matches({v}, 'ON|SW|SP|DP') THEN 'Switches' ELSE 'Potentiometers' END
        WHEN {r} = 'CLR' OR (starts_with({r}, 'R') AND NOT starts_with({r}, 'RANGE')) THEN 'Resistors'
        WHEN starts_with({r}, 'C') THEN 'Capacitors' WHEN starts_with({r}, 'D') THEN 'Diodes'
        WHEN starts_with({r}, 'Q') THEN 'Transistors' WHEN starts_with({r}, 'SW') THEN 'Switches'
        WHEN starts_with({r}, 'LED') THEN 'Diodes' WHEN {starts(r, ['X', 'Y'])} THEN 'Crystals/Oscillators'
        WHEN starts_with({r}, 'J') THEN 'Hardware/Misc' WHEN {starts(r, ['U', 'IC', 'OP', 'TL'])} THEN 'ICs' ELSE 'Unknown' END"""


def normal(cat: str, v: str, number: str) -> str:
    return f"CASE WHEN {cat} IN ('Resistors', 'Capacitors') AND NOT contains(lower({v}), 'mm') AND {number} IS NOT NULL THEN {form(number)} ELSE {v} END"


def spec(cat: str, f: str) -> str:
    return f"CASE WHEN {cat} <> 'Capacitors' OR {f} IS NULL THEN '' WHEN {f} < 1e-9 THEN 'MLCC' WHEN {f} < 1e-6 OR abs({f} - 1e-6) < 1e-9 THEN 'Box Film' ELSE 'Electrolytic' END"


def lookup(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def buy(c: str, v: str, n: str, f: str) -> str:
    return f"""CAST(CASE WHEN {n} <= 0 THEN 0
        WHEN {c} = 'Resistors' THEN CAST(ceil(({n} + 5) / 10.0) AS BIGINT) * 10
        WHEN {c} IN ('Optoelectronics', 'Transistors', 'Crystals/Oscillators') THEN {n} + 1
        WHEN {c} = 'Capacitors' THEN {n} + CASE WHEN abs({f} - 1e-7) < 1e-9 THEN 10 WHEN {f} >= 1e-6 THEN 1 ELSE 5 END
        WHEN {c} = 'Diodes' THEN greatest(10, {n} + 5)
        WHEN {c} = 'Hardware/Misc' AND regexp_matches({v}, 'ADAPTER|SOCKET') THEN {n} + 1 ELSE {n} END AS BIGINT)"""


def note(c: str, v: str, n: str, f: str) -> str:
    s, t = spec(c, f), K.NOTES
    cap = f"""concat_ws(' | ', CASE WHEN abs({f} - 1e-7) < 1e-9 THEN {q(t["bypass"])} END, CASE WHEN {f} > 0.01 THEN {q(t["cap_high"])} END,
        CASE WHEN {s} = '' THEN NULL WHEN {s} = 'Box Film' AND abs({f} - 1e-6) < 1e-9 THEN {q(t["cap_1u"])} WHEN {s} = 'MLCC' THEN {q(t["cap_mlcc"])} ELSE {q(t["cap"])} || {s} END)"""
    chip = lookup(f"regexp_replace({v}, '(CP|CN|P|N)$', '')", K.substitutes(K.IC_SUBSTITUTES))
    return f"""CASE WHEN {n} <= 0 THEN ''
        WHEN {c} = 'Resistors' THEN CASE WHEN {f} < 1 THEN {q(t["resistor_low"])} ELSE {q(t["resistor"])} END
        WHEN {c} = 'Capacitors' THEN {cap}
        WHEN {c} = 'Diodes' THEN coalesce({lookup(v, K.substitutes(K.DIODE_SUBSTITUTES))}, '')
        WHEN {c} = 'Transistors' THEN CASE WHEN contains(upper({v}), '2N5457') THEN {q(t["obsolete"])} WHEN contains(upper({v}), 'MMBF') THEN {q(t["smd"])} ELSE '' END
        WHEN {c} = 'ICs' THEN concat_ws(' | ', {q(t["ic"])}, {chip})
        WHEN {c} = 'Crystals/Oscillators' THEN {q(t["crystal"])}
        WHEN {c} = 'Hardware/Misc' THEN CASE WHEN contains({v}, 'ADAPTER') THEN {q(t["adapter"])} WHEN contains({v}, 'SOCKET') THEN {q(t["socket"])} ELSE '' END
        WHEN {c} = 'PCB' THEN {q(t["pcb"])} ELSE '' END"""


def term(c: str, v: str, f: str, bare: str, pot: str) -> str:
    taper = "CASE " + " ".join(f"WHEN contains(upper({v}), '{k}') THEN '{name}'" for k, name in K.TAPERS.items()) + " ELSE 'Linear' END"
    farad = f"CASE WHEN regexp_matches({v}, '[pnu]$') THEN {v} || 'F' ELSE {v} END"
    s = spec(c, f)
    return f"""CASE WHEN {c} = 'Resistors' THEN {v} || ' ohm 1/4w metal film'
        WHEN {c} = 'Capacitors' THEN CASE {s} WHEN 'MLCC' THEN {farad} || ' multilayer' WHEN '' THEN {farad} ELSE {farad} || ' ' || {s} END
        WHEN {c} = 'Potentiometers' THEN CASE WHEN regexp_matches(upper({v}), 'DUAL|STEREO') THEN 'Dual Gang ' ELSE '' END
          || CASE WHEN {pot} IS NOT NULL THEN {form(pot)} WHEN {bare} <> '' THEN {bare} ELSE {v} END || ' ohm ' || {taper} || ' potentiometer'
        WHEN {c} = 'Diodes' THEN CASE WHEN upper({v}) = 'LED' THEN 'LED 3mm' ELSE {v} END
        WHEN {v} = '8 PIN DIP SOCKET' THEN '8 pin DIP IC Socket Adaptor Solder Type'
        WHEN contains(upper({v}), 'JRC4558') THEN 'NJM4558D' ELSE {v} END"""


def quoted(x: str) -> str:
    return f"replace(replace(url_encode({x}), '%20', '+'), '%7E', '~')"


def tayda(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' ELSE {q(K.TAYDA)} || {quoted(x)} END"


def pedalpcb(x: str) -> str:
    bare = f"trim(replace({x}, ' PCB', ''))"
    return f"CASE WHEN {x} = '' THEN '' ELSE {q(K.PEDALPCB[0])} || {quoted(bare)} || {q(K.PEDALPCB[1])} END"


def rank(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(K.CATEGORIES)) + " ELSE 100 END"


def z(c: str, v: str) -> str:
    rest = " ".join(f"WHEN {q(x)} THEN {i}" for x, i in K.Z_HEIGHT.items())
    return f"CASE WHEN contains(upper({v}), 'SOCKET') THEN 18 WHEN {c} = 'Capacitors' THEN CASE WHEN contains({v}, 'u') OR contains({v}, 'µ') THEN 60 ELSE 40 END ELSE CASE {c} {rest} ELSE 99 END END"


AT = "at1, at2, at3, at4"
BASE = f"""
WITH bom AS ({LINES.format(lineitem="lineitem")}),
cut AS (SELECT *, upper(regexp_extract(line, '^(\\S+)', 1)) AS head, regexp_matches(line, '{TOKEN}') AS tok FROM bom),
raw AS (SELECT *, CASE WHEN head <> 'PCB' AND tok THEN upper(regexp_extract(line, '{TOKEN}', 1)) END AS ref_raw,
        CASE WHEN head <> 'PCB' AND tok THEN regexp_extract(line, '{TOKEN}', 2) END AS val_raw FROM cut),
spans AS (SELECT *, regexp_matches(ref_raw, '{RANGE}') AS ranged, regexp_extract(ref_raw, '{RANGE}', 1) AS prefix,
        TRY_CAST(regexp_extract(ref_raw, '{RANGE}', 2) AS BIGINT) AS a, TRY_CAST(regexp_extract(ref_raw, '{RANGE}', 3) AS BIGINT) AS b FROM raw),
lists AS (SELECT *, CASE WHEN ref_raw IS NULL OR (ranged AND b < a) THEN [] WHEN ranged AND b - a < 50
        THEN list_transform(range(a, b + 1), lambda i: prefix || CAST(i AS VARCHAR)) ELSE [ref_raw] END AS refs FROM spans),
each AS (SELECT * EXCLUDE (refs), unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS pos FROM lists),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot, ref ORDER BY {AT}, pos) AS nth FROM each) WHERE nth = 1),
kinds AS (SELECT *, upper(ref) AS rup, upper(val_raw) AS up, {parse("val_raw")} AS number FROM fresh),
named AS (SELECT *, {category("rup", "up")} AS category FROM kinds),
parts AS (SELECT *, CASE WHEN category = 'Optoelectronics' THEN val_raw ELSE {normal("category", "val_raw", "number")} END AS value FROM named WHERE category IS NOT NULL),
perline AS (SELECT slot, {AT}, count(*) AS found FROM parts GROUP BY ALL),
lines AS (SELECT cut.*, coalesce(found, 0) AS found, regexp_extract(line, '^\\S+\\s+(.*)$', 1) AS rest FROM cut LEFT JOIN perline USING (slot, {AT})),
boards AS (SELECT slot, {AT}, CASE WHEN head = 'PCB' THEN rest ELSE line END AS value FROM lines
        WHERE (head = 'PCB' AND rest <> '') OR (head <> 'PCB' AND found = 0 AND contains(upper(line), 'PCB'))),
rejected AS (SELECT * FROM lines WHERE head <> 'PCB' AND found = 0 AND NOT contains(upper(line), 'PCB')),
events AS (SELECT slot, {AT}, pos, category, value, ref, 'part' AS kind FROM parts
    UNION ALL SELECT slot, {AT}, pos, 'Hardware/Misc', 'DIP SOCKET (Check Size)', ref || ' (Inj)', 'socket' FROM parts
        WHERE category = 'ICs' AND NOT regexp_matches(up, '{any_of(K.NO_SOCKET)}')
    UNION ALL SELECT slot, {AT}, 0, 'PCB', value, '', 'pcb' FROM boards),
projects AS (SELECT *, CASE WHEN trim(name) <> '' THEN name ELSE 'Project #' || CAST(slot + 1 AS VARCHAR) END AS source FROM ({PROJECTS.format(orders="orders")})),
stock_rows AS ({STOCK.format(part="part")}),
stock_parsed AS (SELECT trim(Category) AS category, trim(Part) AS part, TRY_CAST(trim(Qty) AS BIGINT) AS qty, {parse("trim(Part)")} AS number FROM stock_rows
        WHERE trim(Category) <> '' AND trim(Part) <> '' AND regexp_matches(trim(Qty), '^[+-]?[0-9]+$')),
stock AS (SELECT category, {normal("category", "part", "number")} AS value, CAST(sum(qty) AS BIGINT) AS qty FROM stock_parsed GROUP BY ALL),
bill AS (SELECT category, value, CAST(sum(count) AS BIGINT) AS qty, bool_or(contains(source, 'PedalPCB')) AS pedalpcb, bool_or(contains(source, 'Tayda')) AS tayda
        FROM events JOIN projects USING (slot) GROUP BY ALL),
totals AS (SELECT (SELECT CAST(sum(count) AS BIGINT) FROM projects) AS pedals, (SELECT CAST(coalesce(sum(qty), 0) AS BIGINT) FROM bill WHERE category = 'Potentiometers') AS pots,
        (SELECT bool_or(contains(upper(value), 'FUZZ')) FROM bill WHERE category = 'PCB') AS fuzz),
kit AS (SELECT category, value, CAST(each * pedals AS BIGINT) AS qty, note FROM totals, (VALUES {", ".join(f"({q(c)}, {q(v)}, {n}, {q(t)})" for c, v, n, t in K.HARDWARE)}) h(category, value, each, note)
    UNION ALL SELECT 'Transistors', 'Germanium PNP', 0, 'Vintage Option' FROM totals WHERE fuzz
    UNION ALL SELECT 'Hardware/Misc', 'Knob', pots, 'Knobs (' || pots || ')' FROM totals WHERE pots > 0
    UNION ALL SELECT 'Hardware/Misc', 'Dust Seal Cover', pots, 'Pot Seals (' || pots || ')' FROM totals WHERE pots > 0),
merged AS (SELECT category, value, CAST(sum(qty) AS BIGINT) AS qty, bool_or(pedalpcb) AS pedalpcb, bool_or(tayda) AS tayda, bool_or(parsed) AS parsed, max(auto) AS auto FROM (
        SELECT category, value, qty, pedalpcb, tayda, true AS parsed, NULL AS auto FROM bill
        UNION ALL SELECT category, value, qty, false, false, false, 'Auto-Inject (' || note || ')' FROM kit) GROUP BY ALL),
netted AS (SELECT m.*, coalesce(s.qty, 0) AS in_stock, greatest(0, m.qty - coalesce(s.qty, 0)) AS net, {parse("m.value")} AS number,
        regexp_replace(upper(m.value), '[ABCWG\\-\\s]', '', 'g') AS bare,
        CASE WHEN NOT parsed THEN 'Hardware Kit' WHEN regexp_matches(m.value, 'SOCKET|ADAPTER') THEN 'Extras' ELSE 'Circuit Board' END AS origin
        FROM merged m LEFT JOIN stock s USING (category, value)),
potted AS (SELECT *, {parse("bare")} AS pot FROM netted),
termed AS (SELECT *, {term("category", "value", "number", "bare", "pot")} AS term FROM potted),
shopping AS (SELECT origin, category, value AS part, qty AS bom_qty, CAST(in_stock AS BIGINT) AS in_stock, CAST(net AS BIGINT) AS net_need, {buy("category", "value", "net", "number")} AS buy_qty,
        {note("category", "value", "net", "number")} || CASE WHEN auto IS NOT NULL AND origin <> 'Hardware Kit' THEN {q(" | " + K.NOTES["standard"])} || auto ELSE '' END AS notes,
        term AS search_term, CASE WHEN category = 'PCB' AND pedalpcb AND NOT tayda THEN {pedalpcb("term")} ELSE {tayda("term")} END AS link FROM termed),
by_source AS (SELECT category, value, source, count(*) AS n FROM (SELECT DISTINCT slot, category, value, kind, CASE WHEN kind = 'pcb' THEN 'PCB' ELSE ref END AS ref FROM events) JOIN projects USING (slot) GROUP BY ALL),
sheet AS (SELECT DISTINCT source AS project, category, value, CASE WHEN kind = 'pcb' THEN 'PCB' ELSE ref END AS ref FROM events JOIN projects USING (slot)),
islands AS (SELECT *, regexp_matches(ref, '^[a-zA-Z]+[0-9]+') AS known, regexp_extract(ref, '^([a-zA-Z]+)([0-9]+)', 1) AS p, TRY_CAST(regexp_extract(ref, '^([a-zA-Z]+)([0-9]+)', 2) AS BIGINT) AS n FROM sheet),
breaks AS (SELECT *, CASE WHEN known AND n = lag(n) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM islands WINDOW w AS (PARTITION BY project, category, value, known, p ORDER BY n, ref)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY project, category, value, known, p ORDER BY n, ref ROWS UNBOUNDED PRECEDING) AS island FROM breaks),
ranges AS (SELECT project, category, value, known, p, island, min(n) AS first, max(n) AS last, min(ref) AS ref FROM numbered GROUP BY project, category, value, known, p, island),
condensed AS (SELECT project, category, value, string_agg(CASE WHEN NOT known THEN ref WHEN first = last THEN p || first ELSE p || first || '-' || p || last END, ', ' ORDER BY known, p, island, ref) AS refs FROM ranges GROUP BY ALL),
pieces AS (SELECT project, category, value, CAST(count(*) AS BIGINT) AS qty FROM sheet GROUP BY ALL)
"""

#: The same over CSV rows: no board lines, references as they are written.
CSV = BASE.replace(f"CASE WHEN head <> 'PCB' AND tok THEN upper(regexp_extract(line, '{TOKEN}', 1)) END", f"CASE WHEN tok THEN regexp_extract(line, '{TOKEN}', 1) END").replace("CASE WHEN head <> 'PCB' AND tok THEN", "CASE WHEN tok THEN")
VALUE_ROWS = f"WITH vals AS ({VALUES.format(lineitem='lineitem')}), v AS (SELECT value, {parse('value')} AS number FROM vals)"
DIP = "CASE WHEN contains(upper(value), 'DIP SOCKET') THEN 'DIP Socket' ELSE value END"
POLAR = "(category IN ('Diodes', 'Transistors', 'ICs') OR (category = 'Capacitors' AND (contains(value, 'u') OR contains(value, 'µ'))))"
ORDERED = f"{rank('category')}, coalesce({parse('value')}, 0), value"

#: R2 before R10: each run of digits by its number, after what stands before it.
NATURAL = r"list_transform(regexp_extract_all(upper(ref), '[^0-9]*[0-9]+|[^0-9]+'), lambda p: {'t': regexp_extract(p, '^([^0-9]*)', 1), 'n': coalesce(TRY_CAST(regexp_extract(p, '([0-9]+)$', 1) AS HUGEINT), -1)})"

ORACLES: dict[str, str] = {
    "shopping_list": BASE + "SELECT * FROM shopping",
    "text_scan_stats": BASE
    + """, p AS (SELECT slot, count(*) AS n FROM parts GROUP BY slot), b AS (SELECT slot, count(*) AS n FROM boards GROUP BY slot), r AS (SELECT slot, count(*) AS n FROM rejected GROUP BY slot)
        SELECT l.slot, l.n AS lines_read, coalesce(p.n, 0) + coalesce(b.n, 0) AS parts_found, coalesce(r.n, 0) AS residuals
        FROM (SELECT slot, count(*) AS n FROM bom GROUP BY slot) l LEFT JOIN p USING (slot) LEFT JOIN b USING (slot) LEFT JOIN r USING (slot)""",
    "residual_report": BASE + f"SELECT line, count(*) AS n FROM rejected WHERE regexp_matches(upper(line), 'ERROR|EXCEPTION') OR (NOT regexp_matches(upper(line), '{any_of(K.SAFE_WORDS)}') AND regexp_matches(line, '[0-9]')) GROUP BY line",
    "pcb_lines": BASE + "SELECT value, count(*) AS n FROM boards GROUP BY value",
    "si_parse": VALUE_ROWS + "SELECT value, number FROM v",
    "si_search_string": VALUE_ROWS + f"SELECT value, {form('number')} AS search FROM v",
    "si_display_string": VALUE_ROWS + rf"SELECT value, regexp_replace({form('number')}, '^([^.]*)\.([0-9]+)([a-zA-Z]+).*$', '\1\3\2') AS display FROM v",
    "normalize_value": VALUE_ROWS + f"SELECT category, value, {normal('category', 'value', 'number')} AS normal FROM v, (VALUES ('Resistors'), ('Capacitors'), ('Diodes')) c(category)",
    "spec_type": VALUE_ROWS + f"SELECT value, {spec(q('Capacitors'), 'number')} AS spec FROM v",
    "expand_refs": BASE + "SELECT DISTINCT ref_raw, CAST(pos AS INTEGER) AS pos, ref FROM each",
    "first_wins_dedupe": BASE + "SELECT slot, ref, val_raw FROM fresh",
    "classify_parts": BASE + "SELECT DISTINCT ref, val_raw, category, CASE WHEN category = 'Optoelectronics' THEN val_raw WHEN category IS NOT NULL THEN " + normal("category", "val_raw", "number") + " END AS value FROM named",
    "socket_injection": BASE + "SELECT slot, ref FROM events WHERE kind = 'socket'",
    "inventory_agg": BASE + "SELECT category, value, count(*) AS qty, count(*) FILTER (ref <> '') AS n_refs, min(slot) AS first_slot FROM events GROUP BY ALL",
    "inventory_merge_weighted": BASE + "SELECT category, value, CAST(sum(count) AS BIGINT) AS qty, count(*) FILTER (ref <> '') AS n_refs, min(slot) AS first_slot FROM events JOIN projects USING (slot) GROUP BY ALL",
    "inventory_sources": BASE + "SELECT category, value, source, n FROM by_source",
    "inventory_sources_weighted": BASE
    + "SELECT category, value, source, CAST(sum(count) AS BIGINT) AS n FROM (SELECT DISTINCT slot, category, value, kind, CASE WHEN kind = 'pcb' THEN 'PCB' ELSE ref END AS ref FROM events) JOIN projects USING (slot) GROUP BY ALL",
    "inventory_source_lists": BASE
    + f""", marked AS (SELECT slot, {AT}, pos, category, value, kind, ref FROM events WHERE kind <> 'pcb' AND ref <> ''
            UNION ALL SELECT slot, first.at1, first.at2, first.at3, first.at4, 0, category, value, 'pcb', 'PCB'
            FROM (SELECT slot, category, value, min({{'at1': at1, 'at2': at2, 'at3': at3, 'at4': at4}}) AS first FROM events WHERE kind = 'pcb' GROUP BY ALL)),
        listed AS (SELECT category, value, source, ref, count, row_number() OVER w - 1 AS place, sum(count) OVER w - count AS begins
            FROM marked JOIN projects USING (slot) WHERE count > 0 WINDOW w AS (PARTITION BY category, value, source ORDER BY slot, {AT}, pos, kind, ref ROWS UNBOUNDED PRECEDING))
        SELECT category, value, source, CAST(place // 1024 AS BIGINT) AS chunk, CAST(min(begins) AS BIGINT) AS begins, CAST(sum(count) AS BIGINT) AS n, string_agg(ref || '*' || CAST(count AS VARCHAR), ' ' ORDER BY place) AS refs
        FROM listed GROUP BY category, value, source, place // 1024""",
    "sku_count": BASE + "SELECT count(*) AS skus FROM (SELECT DISTINCT category, value FROM events)",
    "preset_lookup": f"""SELECT slot, a.key, CASE WHEN k.key IS NULL THEN '' ELSE 'R1 10k # ' || k.key END AS payload FROM (
        SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 3 = 0 THEN '[None] such' ELSE '[Tayda] Box ' || CAST(o_custkey % 80 AS VARCHAR) END AS key FROM orders) a
        LEFT JOIN ({PRESET_KEYS.format(orders='orders')}) k ON a.key = k.key""",
    "rename_source": BASE
    + """SELECT category, value, CASE source WHEN 'PedalPCB 1' THEN 'PedalPCB 2' ELSE source END AS source, n FROM by_source s
        WHERE source <> 'PedalPCB 2' OR NOT EXISTS (SELECT 1 FROM by_source o WHERE o.source = 'PedalPCB 1' AND o.category = s.category AND o.value = s.value)""",
    "stock_parse": BASE + "SELECT category, value, qty FROM stock",
    "net_needs": BASE + "SELECT b.category, b.value, b.qty, CAST(coalesce(s.qty, 0) AS BIGINT) AS in_stock, CAST(greatest(0, b.qty - coalesce(s.qty, 0)) AS BIGINT) AS net FROM bill b LEFT JOIN stock s USING (category, value)",
    "missing_from_stock": BASE + "SELECT category, value, qty FROM bill b WHERE NOT EXISTS (SELECT 1 FROM stock s WHERE s.category = b.category AND s.value = b.value)",
    "buy_details": BASE
    + f"SELECT category, value, need, {buy('category', 'value', 'need', 'number')} AS buy_qty, {note('category', 'value', 'need', 'number')} AS note FROM (SELECT category, value, qty - 40 AS need, {parse('value')} AS number FROM (SELECT category, value, count(*) AS qty FROM events GROUP BY ALL))",
    "substitutions": BASE
    + f"SELECT category, value, hint FROM (SELECT DISTINCT category, value, CASE category WHEN 'Diodes' THEN {lookup('value', K.substitutes(K.DIODE_SUBSTITUTES))} WHEN 'ICs' THEN "
    + lookup("regexp_replace(value, '(CP|CN|P|N)$', '')", K.substitutes(K.IC_SUBSTITUTES))
    + " END AS hint FROM events) WHERE hint IS NOT NULL",
    "hardware_injection": BASE + "SELECT category, value, qty, note FROM kit",
    "germanium_rule": BASE + "SELECT 'Germanium PNP' AS value, CAST(0 AS BIGINT) AS qty FROM totals WHERE fuzz",
    "search_terms": BASE
    + f"SELECT category, value, {term('category', 'value', 'number', 'bare', 'pot')} AS search_term FROM (SELECT *, {parse('bare')} AS pot FROM (SELECT DISTINCT category, value, {parse('value')} AS number, regexp_replace(upper(value), '[ABCWG\\-\\s]', '', 'g') AS bare FROM events))",
    "vendor_urls": BASE + f"SELECT name, {tayda('name')} AS tayda, {pedalpcb('name')} AS pedalpcb FROM (SELECT DISTINCT name || ' PCB' AS name FROM projects)",
    "stock_update": BASE + "SELECT category, part, CAST(in_stock + buy_qty - bom_qty AS BIGINT) AS qty FROM shopping WHERE in_stock + buy_qty - bom_qty > 0",
    "excel_links": BASE + """SELECT category AS "Category", part AS "Part", bom_qty AS "BOM Qty", in_stock AS "In Stock", net_need AS "Net Need", buy_qty AS "Buy Qty", notes AS "Notes", search_term AS "Search Term",
        CASE WHEN link <> '' THEN '=HYPERLINK("' || link || '", "Buy")' ELSE link END AS "Tayda_Link", origin AS "Origin" FROM shopping""",
    "origin_filter": BASE + "SELECT origin, category, part, bom_qty FROM shopping WHERE origin <> 'Hardware Kit' AND NOT regexp_matches(part, 'SOCKET|ADAPTER')",
    "sort_inventory": BASE + f"SELECT category, value, row_number() OVER (ORDER BY {ORDERED}, category) AS place FROM bill",
    "z_height_order": BASE + f"SELECT category, value, {z('category', 'value')} AS z, row_number() OVER (ORDER BY {z('category', 'value')}, first_slot, category, value) AS place FROM (SELECT category, value, min(slot) AS first_slot FROM events GROUP BY ALL)",
    "natural_sort": BASE + "SELECT ref, row_number() OVER (ORDER BY " + NATURAL + ", ref) AS place FROM (SELECT DISTINCT ref FROM fresh)",
    "condense_refs": BASE + "SELECT project, category, value, refs FROM condensed",
    "sticker_grid": BASE
    + f"""SELECT project, code, category, value, qty, label, refs, CAST(n // 30 AS INTEGER) AS page, CAST(n % 30 // 3 AS INTEGER) AS row, CAST(n % 30 % 3 AS INTEGER) AS col FROM (
        SELECT project, substring(upper(regexp_replace(project, '[^\\p{{L}}\\p{{N}}]', '', 'g')), 1, 4) AS code, category, value, qty, substring({DIP}, 1, 18) AS label,
          CASE WHEN qty > 1 THEN '(x' || qty || ') ' ELSE '' END || refs AS refs, row_number() OVER (PARTITION BY project ORDER BY value, category) - 1 AS n
        FROM pieces JOIN condensed USING (project, category, value))""",
    "field_manual": BASE
    + f""", listed AS (SELECT project, category, value, string_agg(ref, ', ' ORDER BY {NATURAL}, ref) AS refs FROM sheet GROUP BY ALL)
        SELECT project, category, value, qty, refs, CASE WHEN length(refs) > 50 THEN substring(refs, 1, 47) || '...' ELSE refs END AS shown_refs, notes, polarized, z, substring(CASE WHEN words <> '' AND NOT contains({DIP}, 'DIP Socket') THEN {DIP} || ' [' || words || ']' ELSE {DIP} END, 1, 35) AS shown_value FROM (
        SELECT *, CASE WHEN notes <> '' THEN replace(notes, '[!] ', '') WHEN polarized THEN 'Polarized' ELSE '' END AS words FROM (
        SELECT *, CASE WHEN contains(value, 'DIP SOCKET') THEN '[!] Check Size' ELSE '' END AS notes, {POLAR} AS polarized, CAST({z("category", "value")} AS INTEGER) AS z FROM pieces JOIN listed USING (project, category, value)))""",
    "serialize_inventory": BASE
    + f""", placed AS (SELECT category, value, count(*) AS qty, count(*) FILTER (ref <> '') AS n, row_number() OVER (ORDER BY {ORDERED}, category) AS place FROM events GROUP BY category, value)
        SELECT CAST(place AS INTEGER) AS "at", CAST(row_number() OVER (PARTITION BY place ORDER BY slot, {AT}, pos, kind, ref) - 1 AS INTEGER) AS pos, ref || ' ' || value AS line FROM events JOIN placed USING (category, value) WHERE ref <> ''
        UNION ALL SELECT CAST(place AS INTEGER), 0, value || ' (Qty: ' || qty || ')' FROM placed WHERE n = 0""",
    "slot_names": BASE + "SELECT slot, source FROM projects",
    "locked_names": BASE + "SELECT slot, CASE WHEN trim(name) <> '' THEN name WHEN slot % 3 = 0 THEN 'Title ' || CAST(slot AS VARCHAR) ELSE source END AS locked_name FROM projects",
    "total_stats": BASE + "SELECT (SELECT count(*) FROM bom) AS lines_read, (SELECT count(*) FROM parts) + (SELECT count(*) FROM boards) AS parts_found, (SELECT count(*) FROM rejected) AS residuals",
    "injection_warnings": BASE
    + """SELECT CASE value WHEN 'ADAPTER' THEN '⚠️  SMD ADAPTERS: Added for MMBF5457. Check if your PCB has SOT-23 pads first.' ELSE 'ℹ️  IC SOCKETS: Added sockets for chips. Optional but recommended.' END AS warning
        FROM (SELECT DISTINCT value FROM events WHERE category = 'Hardware/Misc' AND value IN ('ADAPTER', 'SOCKET8'))""",  # noqa: RUF001
    "first_preset": f"SELECT min(key) AS full_key FROM ({PRESET_KEYS.format(orders='orders')}) WHERE regexp_matches(key, '{KEY}')",
    "csv_payloads": CSV
    + """SELECT b.slot, b.n AS lines_read, coalesce(p.n, 0) AS parts_found, b.n - coalesce(g.n, 0) AS residuals FROM (SELECT slot, count(*) AS n FROM bom GROUP BY slot) b
        LEFT JOIN (SELECT slot, count(*) AS n FROM parts GROUP BY slot) p USING (slot) LEFT JOIN (SELECT slot, count(*) AS n FROM perline GROUP BY slot) g USING (slot)""",
    "dup_projects": BASE + "SELECT name, count(*) AS n FROM projects WHERE trim(name) <> '' GROUP BY name HAVING count(*) > 1",
    "archive_manifest": BASE
    + """SELECT project, path FROM (SELECT DISTINCT name AS project, trim(regexp_replace(name, '[<>:"/\\\\|?*]', '', 'g')) AS safe FROM projects WHERE name <> ''), unnest(['Field Manuals/' || safe || ' Field Manual.pdf', 'Sticker Sheets/' || safe || ' Sticker Sheet.pdf']) u(path)""",
    "clean_name": f"SELECT key, CASE WHEN regexp_matches(key, '{KEY}') THEN regexp_extract(key, '{KEY}', 3) || ' - ' || regexp_extract(key, '{KEY}', 1) ELSE key END AS name FROM ({PRESET_KEYS.format(orders='orders')})",
    "preset_metadata": f"SELECT key AS full_key, regexp_extract(key, '{KEY}', 1) AS source, coalesce(nullif(regexp_extract(key, '{KEY}', 2), ''), 'Misc') AS category, regexp_extract(key, '{KEY}', 3) AS name FROM ({PRESET_KEYS.format(orders='orders')}) WHERE regexp_matches(key, '{KEY}')",
    "preset_categories": f"SELECT DISTINCT regexp_extract(key, '{KEY}', 1) AS source, coalesce(nullif(regexp_extract(key, '{KEY}', 2), ''), 'Misc') AS category FROM ({PRESET_KEYS.format(orders='orders')}) WHERE regexp_matches(key, '{KEY}')",
    "preset_labels": f"""SELECT full_key, CASE WHEN category = 'Misc' THEN name ELSE name || '  (' || category || ')' END AS label FROM (
        SELECT key AS full_key, coalesce(nullif(regexp_extract(key, '{KEY}', 2), ''), 'Misc') AS category, regexp_extract(key, '{KEY}', 3) AS name FROM ({PRESET_KEYS.format(orders='orders')}) WHERE regexp_extract(key, '{KEY}', 1) = 'Tayda')""",
    "document_scan": r"""
        SELECT doc_id AS slot, count(*) AS lines_read, count(*) FILTER (regexp_matches(line, '^[a-zA-Z0-9_\-]+[\s,]+[0-9a-zA-Z./\-]+')) AS tokens
        FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents) WHERE line <> '' GROUP BY doc_id""",
    "csv_file_scan": "SELECT doc_id, nullif(source, '') AS source, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "csv_scan": CSV
    + """SELECT b.slot, b.n AS lines_read, coalesce(p.n, 0) AS parts_found, b.n - coalesce(g.n, 0) AS residuals FROM (SELECT slot, count(*) AS n FROM bom GROUP BY slot) b
        LEFT JOIN (SELECT slot, count(*) AS n FROM parts GROUP BY slot) p USING (slot) LEFT JOIN (SELECT slot, count(*) AS n FROM perline GROUP BY slot) g USING (slot)""",
    "pdf_tables": BASE
    + f"SELECT slot, regexp_extract(line, '{TOKEN}', 1) AS ref_raw, regexp_extract(line, '{TOKEN}', 2) AS val_raw FROM bom WHERE slot % 2 = 0 AND regexp_matches(line, '{TOKEN}')",
    "pdf_title": BASE + "SELECT DISTINCT slot, 'Big Drive' AS title FROM bom",
    "page_route": "SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN ends_with(lower(trim(url)), '.pdf') OR starts_with(html, '%PDF') THEN 'pdf' ELSE 'text' END AS kind FROM pages",
}

#: All projects as pages: the table's rows, then matches in the text, loose where the table gave no part.
_WORDS = "|".join(rf"\b{k}\b" for k in K.KEYWORDS)
_LOOSE = rf"\b[A-Z]{{1,4}}[0-9]+\b|{_WORDS}"
_MARKED = " ".join(["CASE WHEN slot IN (SELECT slot FROM have)", *(rf"{when} regexp_replace(text, '(?i)((?:{words})\s+\S+)', chr(1) || '\1', 'g')" for when, words in (("THEN", _WORDS), ("ELSE", _LOOSE))), "END"])
_LISTED = ", ".join(q(k) for k in K.KEYWORDS)
PDF = rf"""
WITH bom AS ({LINES.format(lineitem="lineitem")}),
have AS (SELECT DISTINCT slot FROM ({CSV} SELECT slot FROM parts) WHERE slot % 2 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY {AT}) AS nth FROM bom),
texts AS (SELECT slot, string_agg(line, chr(10) ORDER BY nth) AS text FROM placed GROUP BY slot),
cutting AS (SELECT slot, string_split({_MARKED}, chr(1)) AS cuts FROM texts),
matches AS (SELECT slot, unnest(cuts) AS part, generate_subscripts(cuts, 1) AS nth FROM cutting),
read AS (SELECT slot, nth, upper(regexp_extract(part, '(?is)^({_LOOSE})\s+(.*)$', 1)) AS name, regexp_extract(part, '(?is)^({_LOOSE})\s+(.*)$', 2) AS rest FROM matches WHERE nth > 1),
taken AS (SELECT *, name IN ({_LISTED}) AS keyword, CASE WHEN name IN ({_LISTED}) OR regexp_matches(name, '^(LDR|POT|VR)') THEN trim(regexp_extract(rest, '^([^\n]*)', 1)) ELSE regexp_extract(rest, '^(\S+)', 1) END AS val FROM read),
bare AS (SELECT * EXCLUDE (val), CASE WHEN regexp_matches(val, '^\(.*\)$|^\[.*\]$') THEN trim(substr(val, 2, length(val) - 2)) ELSE val END AS val FROM taken),
usable AS (SELECT * FROM bare WHERE length(val) BETWEEN 1 AND 50 AND NOT regexp_matches(upper(val), '{any_of(K.IGNORE_VALUES)}') AND NOT regexp_matches(val, '(?i)^(?:is|see|note)\s')
        AND NOT regexp_matches(val, '^[0-9]{{1,2}}[.\-/][0-9]{{1,2}}[.\-/][0-9]{{2,4}}')
        AND CASE WHEN keyword THEN (regexp_matches(val, '[0-9]') OR regexp_matches(upper(val), 'SPDT|DPDT|3PDT|ON/ON|ON/OFF')) AND NOT regexp_matches(upper(val), '^(IC|DIP|SOIC|PKG|MODULE|PCB|TL|OP|NE5)')
            AND NOT (regexp_matches(upper(val), 'DIP|SOIC') AND NOT regexp_matches(val, '[0-9]'))
          ELSE regexp_matches(name, '^({any_of(K.PDF_PREFIXES)})') AND NOT (length(name) >= 3 AND regexp_matches(val, '^[0-9]+$')) END),
raw AS (SELECT slot, 0 AS at1, nth AS at2, 0 AS at3, 0 AS at4, regexp_extract(line, '{TOKEN}', 1) AS ref_raw, regexp_extract(line, '{TOKEN}', 2) AS val_raw FROM placed WHERE slot % 2 = 0 AND regexp_matches(line, '{TOKEN}')
    UNION ALL SELECT slot, 1, nth, 0, 0, name, val FROM usable),
spans AS {BASE.split("spans AS", 1)[1].split("perline AS", 1)[0].rstrip().rstrip(",")}
"""

ORACLES["pdf_regex_scan"] = PDF + """SELECT b.slot, b.n AS lines_read, coalesce(p.n, 0) AS parts_found FROM (SELECT slot, count(*) FILTER (slot % 2 = 0) AS n FROM bom GROUP BY slot) b
    LEFT JOIN (SELECT slot, count(*) AS n FROM parts GROUP BY slot) p USING (slot)"""
ORACLES["mixed_intake"] = f"""SELECT slot, lines_read, parts_found, CAST(NULL AS VARCHAR) AS error FROM ({ORACLES["text_scan_stats"]}) WHERE slot % 4 = 0
    UNION ALL SELECT slot, lines_read, parts_found, NULL FROM ({ORACLES["csv_payloads"]}) WHERE slot % 4 IN (1, 2)
    UNION ALL SELECT DISTINCT l_orderkey, 0, 0, 'Unknown Method' FROM lineitem WHERE l_orderkey % 4 = 3"""

ORACLES["preset_crawl"] = (
    PDF
    + f""", files AS (SELECT slot, text, slot % 3 AS kind, CASE WHEN slot % 3 = 2 THEN 'Loose Box ' || slot WHEN slot % 5 = 0 THEN 'Big Box ' || slot ELSE 'Big Drive' || slot END AS name,
        CASE slot % 3 WHEN 0 THEN '/lib/pedalpcb/fuzz/big_box-' || slot || '.pdf' WHEN 1 THEN '/lib/tayda/big_box-' || slot || '.PDF' ELSE '/lib/loose_box-' || slot || '.txt' END AS source_path FROM texts),
    had AS (SELECT slot, {AT}, pos, category, value, ref, 'part' AS kind FROM parts
        UNION ALL SELECT slot, {AT}, pos, 'Hardware/Misc', 'DIP SOCKET (Check Size)', ref || ' (Inj)', 'socket' FROM parts WHERE category = 'ICs' AND NOT regexp_matches(up, '{any_of(K.NO_SOCKET)}')
        UNION ALL SELECT slot, 2, 0, 0, 0, 0, 'PCB', name || ' PCB', 'PCB', 'pcb' FROM files WHERE files.kind = 0 AND slot IN (SELECT slot FROM parts)),
    written AS (SELECT slot, string_agg(ref || ' ' || value, chr(10) ORDER BY {ORDERED}, category, {AT}, pos, kind, ref) AS list FROM had GROUP BY slot)
    SELECT source_path, CASE WHEN kind = 2 THEN '[Misc] ' || name WHEN list IS NULL THEN NULL WHEN kind = 0 THEN '[PedalPCB] [Fuzz] ' || name ELSE '[Tayda] ' || name END AS full_key,
        CASE WHEN kind = 2 THEN text ELSE list END AS bom_text, kind <> 2 AS is_pdf, CASE WHEN kind <> 2 AND list IS NULL THEN 'No parts found.' END AS error FROM files LEFT JOIN written USING (slot)"""
)


def _sheet_sql(of: str, name: str, order: str, columns: list[str]) -> str:
    """SQL of one kind of sheet, from the SQL of its rows."""
    cell = lambda c: f"""CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '[",\\r\\n]') THEN '"' || replace(CAST({c} AS VARCHAR), '"', '""') || '"' ELSE CAST({c} AS VARCHAR) END"""
    safe = r"""trim(regexp_replace(project, '[<>:"/\\|?*]', '', 'g'))"""
    line = " || ',' || ".join(cell(c) for c in columns)
    return f"""SELECT replace('{name}', '%s', CASE WHEN nth > 1 THEN safe || ' (' || nth || ')' ELSE safe END) AS path, content FROM (
        SELECT safe, row_number() OVER (PARTITION BY safe ORDER BY project) AS nth, chr(65279) || '{",".join(columns)}' || chr(13) || chr(10) || lines || chr(13) || chr(10) AS content FROM (
        SELECT project, {safe} AS safe, string_agg({line}, chr(13) || chr(10) ORDER BY {order}) AS lines FROM ({of}) GROUP BY project))"""


ORACLES["archive_sheets"] = " UNION ALL ".join([
    _sheet_sql(ORACLES["field_manual"], "Field Manuals/%s Field Manual.csv", "z, value, category", ["qty", "shown_value", "shown_refs"]),
    _sheet_sql(ORACLES["sticker_grid"], "Sticker Sheets/%s Sticker Sheet.csv", "page, row, col", ["code", "label", "refs", "page", "row", "col"]),
])
