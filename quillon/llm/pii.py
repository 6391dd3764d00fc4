"""PII surrogates with DataFrame functions only.

Detected entities (e-mail addresses, phone numbers, payment cards, social security numbers, IPv4 addresses,
IBANs, names after a title) are replaced by keyed surrogates: a SHA-256 of key, type, canonical form and
attempt picks every new character, so digits stay digits, letters keep case and script, separators stay,
cards keep their issuer digit and Luhn state, IBANs their country and whether their check digits hold, phones
with a plus their country code, octets stay octets, names follow the gender of their title and
their script. One canonical form (case folded, separators dropped; a phone's plus stays) has one surrogate
everywhere, in the format of each place: characters are drawn by their rank among letters and digits.

Names are found behind a title (up to three parts, with hyphens and apostrophes); every part of a titled name
is then a name in the whole of its document, titled or not, so "Lee" and "Ann Lee" change with "Mrs. Ann Lee".
Parts have a surrogate each. A given name takes its gender from any gendered title it has in the document, so
"Dr. Ann Lee" and "Mrs. Ann Lee" agree there; in documents where only neutral titles stand, it has another.

Distinctness is checked over the whole corpus: a pre-aggregated table of entities is computed, entities whose
surrogate another entity has too, or that is itself a real entity, move on to their next attempt, until none
collide. With no entity past its first attempt the texts are rewritten without any join; otherwise the
attempts reach the texts by a join on the text's hash.

Defined cases: a null text stays null, an empty one empty; whole texts are rewritten; repeated rows give
repeated rows; of entities that claim one surrogate (a tie) the one that sorts first has it; other columns pass unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._base import materialize, table

KEY = "quillon-demonstration-key"  # callers pass their own secret
ROUNDS = 20

# What counts as an entity.
MALE = "Mr|Herr|Señor|Sr|Monsieur|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа"
NEUTRAL = "Dr|Prof"
PART = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "name": rf"(?<![\p{{L}}0-9])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {PART}(?: {PART}){{0,2}}",
}
# The country codes of the numbering plan, so that they are found in a number without separators.
COUNTRY = "^[+](1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
TITLED = f"^(?:{MALE}|{FEMALE}|{NEUTRAL})[.]? "
SYLLABLES = {
    "latin": ["bal", "cor", "dan", "fel", "gar", "hol", "jas", "kel", "lor", "mar", "nol", "per", "ros", "sel", "tam", "vel"],
    "cyrillic": ["бал", "вер", "гор", "дан", "кал", "лев", "мар", "нол", "пет", "рос", "сел", "там", "фед", "хол", "юр", "яр"],
    "greek": ["αλ", "βασ", "γαλ", "δαμ", "ελ", "θεο", "καλ", "λεν", "μαρ", "νικ", "παλ", "ρον", "σολ", "ταν", "φιλ", "χρυ"],
}
ENDINGS = {
    "latin": {"given_m": ["an", "or", "us", "ik"], "given_f": ["a", "ia", "ena", "ine"], "given_n": ["is", "en", "el", "ey"], "surname": ["son", "ley", "berg", "ton"]},
    "cyrillic": {"given_m": ["ан", "ор", "ий", "ик"], "given_f": ["а", "ия", "ина", "ена"], "given_n": ["ен", "ель", "ис", "ей"], "surname": ["ко", "юк", "ич", "ян"]},
    "greek": {"given_m": ["ος", "ης", "ας", "ων"], "given_f": ["α", "ια", "η", "ινα"], "given_n": ["ις", "εν", "ελ", "υς"], "surname": ["ακης", "ιδης", "ου", "ας"]},
}


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(items: list[str]) -> str:
    return "array(" + ", ".join(map(_quote, items)) + ")"


def _pick(seed: str, at: str, n: int) -> str:
    return f"pmod(xxhash64({seed}, {at}), {n})"


def _parts() -> str:
    """SQL: (part, kind) of every part of the titled names among the document's mentions."""
    title = "substring_index(m, ' ', 1)"
    given = f"CASE WHEN {title} rlike {_quote(f'^(?:{FEMALE})[.]?$')} THEN 'given_f' WHEN {title} rlike {_quote(f'^(?:{MALE})[.]?$')} THEN 'given_m' ELSE 'given_n' END"
    each = f"transform(slice(split(m, ' '), 2, 4), (x, i) -> named_struct('part', x, 'kind', CASE WHEN i = size(split(m, ' ')) - 2 THEN 'surname' ELSE {given} END))"
    return f"array_distinct(flatten(transform(filter(_found, m -> m rlike {_quote(TITLED)}), m -> {each})))"


def _gender(part: str) -> str:
    """SQL: the kind of a given name, by the gendered titles it has in the document."""
    has = lambda k: f"exists(_parts, p -> p.part = {part} AND p.kind = '{k}')"
    return f"CASE WHEN {has('given_f')} AND NOT {has('given_m')} THEN 'given_f' WHEN {has('given_m')} AND NOT {has('given_f')} THEN 'given_m' ELSE 'given_n' END"


def _units(mention: str) -> str:
    """SQL: array of (type, canonical, shown) parts of a mention; type '' is literal."""
    t = lambda kind: f"{mention} rlike {_quote('^(?:' + PATTERNS[kind] + ')$')}"
    one = lambda kind, canon: f"array(named_struct('kind', {_quote(kind)}, 'canon', {canon}, 'shown', {mention}))"
    digits = f"regexp_replace({mention}, '[^0-9]', '')"
    part = lambda kind, x: f"named_struct('kind', {kind}, 'canon', lower({x}), 'shown', {x})"
    lit = lambda x: f"named_struct('kind', '', 'canon', '', 'shown', {x})"
    kind = lambda x, i: f"CASE WHEN {i} = size({mention_parts}) - 1 THEN 'surname' ELSE {_gender(x)} END"
    mention_parts = f"slice(split({mention}, ' '), 2, 4)"
    titled = f"flatten(transform({mention_parts}, (x, i) -> array({lit(_quote(' '))}, {part(kind('x', 'i'), 'x')})))"
    title = f"substring_index({mention}, ' ', 1)"
    bare = f"array({part(f"CASE WHEN exists(_parts, p -> p.part = {mention} AND p.kind = 'surname') THEN 'surname' ELSE {_gender(mention)} END", mention)})"
    name = f"CASE WHEN {mention} rlike {_quote(TITLED)} THEN concat(array({lit(title)}), {titled}) ELSE {bare} END"
    return (
        f"CASE WHEN {t('email')} THEN {one('email', f'lower({mention})')} WHEN {t('iban')} THEN {one('iban', f'replace({mention}, chr(32), {_quote("")})')} "
        f"WHEN {t('card')} THEN {one('card', digits)} WHEN {t('ssn')} THEN {one('ssn', digits)} WHEN {t('ip')} THEN {one('ip', mention)} "
        f"WHEN {t('phone')} THEN {one('phone', f"regexp_replace({mention}, '[^0-9+]', '')")} ELSE {name} END"
    )


def _scrambled(shown: str, seed: str, keep: str = "false", spaced: bool = False) -> str:
    """SQL: each digit and letter of `shown` replaced in kind, but where `keep` holds for place i (from 0).

    With `spaced`, draws and `keep` go by `r`, the rank among letters and digits, so that separators change nothing.
    """
    at = "r" if spaced else "i"
    pick = (
        f"CASE WHEN {keep} THEN c WHEN c rlike '[0-9]' THEN cast({_pick(seed, at, 10)} AS string) "
        f"WHEN c rlike '[a-z]' THEN chr(97 + {_pick(seed, at, 26)}) WHEN c rlike '[A-Z]' THEN chr(65 + {_pick(seed, at, 26)}) ELSE c END"
    )
    if spaced:
        pick = f"element_at(transform(array(length(regexp_replace(substring({shown}, 1, i), '[^0-9A-Za-z]', ''))), r -> {pick}), 1)"
    return f"array_join(transform(split({shown}, ''), (c, i) -> {pick}), '')"


def _let(names: dict[str, str], body: str, var: str) -> str:
    """SQL: body with var.<name> bound to each value, so that a long value is written and computed once."""
    fields = ", ".join(f"'{n}', {v}" for n, v in names.items())
    return f"element_at(transform(array(named_struct({fields})), {var} -> {body}), 1)"


def _mod97(text: str) -> str:
    """SQL: the number that a text of digits and letters (A is 10) stands for, modulo 97."""
    return f"aggregate(split({text}, ''), 0L, (s, c) -> CASE WHEN c = '' THEN s WHEN c rlike '[0-9]' THEN (s * 10 + cast(c AS bigint)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END)"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string modulo 10."""
    d = "cast(d AS bigint)"
    return f"aggregate(transform(reverse(filter(split({digits}, ''), e -> e <> '')), (d, j) -> CASE WHEN j % 2 = 1 THEN ({d} * 2) div 10 + ({d} * 2) % 10 ELSE {d} END), 0L, (s, x) -> s + x)"


def _surrogate(unit: str, attempt: str, key: str) -> str:
    """SQL: the replacement of a unit at an attempt."""
    seed = f"sha2(concat_ws('|', {_quote(key)}, {unit}.kind, {unit}.canon, cast({attempt} AS string)), 256)"
    host = f"sha2(concat_ws('|', {_quote(key)}, 'host', substring_index({unit}.canon, '@', -1)), 256)"
    domain = "substring_index(q.shown, '@', -1)"
    labels = f"substring({domain}, 1, length({domain}) - length(substring_index({domain}, '.', -1)))"
    email = f"concat({_scrambled(f'substring_index(q.shown, {_quote("@")}, 1)', 'q.seed')}, '@', {_scrambled(labels, host)}, substring_index({domain}, '.', -1))"
    # a card: scramble all but the first digit, then set the last one so that the Luhn sum stays what it was
    body = _scrambled("substring(q.shown, 1, length(q.shown) - 1)", "q.seed", "r = 0", spaced=True)
    fix = f"concat(w.body, cast(pmod({_luhn('q.canon')} - {_luhn('concat(regexp_replace(w.body, ' + _quote('[^0-9]') + ', ' + _quote('') + '), ' + _quote('0') + ')')}, 10) AS string))"
    card = _let({"body": body}, fix, "w")
    code = f"length(regexp_extract(q.canon, {_quote(COUNTRY)}, 1))"
    phone = _let({"code": code}, _scrambled("q.shown", "q.seed", "r < w.code", spaced=True), "w")
    ip = f"array_join(transform(sequence(1, 4), i -> cast(1 + {_pick('q.seed', 'i', 254)} AS string)), '.')"
    spelled = lambda script: (  # noqa: E731  more attempts, more syllables
        f"concat(array_join(transform(sequence(1, 2 + q.attempt), i -> element_at({_words(SYLLABLES[script])}, cast(1 + {_pick('q.seed', 'i', 16)} AS int))), ''), "
        f"element_at(CASE q.kind " + " ".join(f"WHEN {_quote(k)} THEN {_words(v)}" for k, v in ENDINGS[script].items()) + f" ELSE array('') END, cast(1 + {_pick('q.seed', '0', 4)} AS int)))"
    )
    # an IBAN: scramble what follows the check digits, then set these so that the remainder stays what it was
    rest = "replace(w.body, chr(32), '')"
    check = f"lpad(cast(2 + pmod({_mod97('concat(substring(q.canon, 5), substring(q.canon, 1, 4))')} - {_mod97(f"concat(substring({rest}, 5), substring({rest}, 1, 2), '00')")} - 2, 97) AS string), 2, '0')"
    iban = _let({"body": _scrambled("q.shown", "q.seed", "r < 4", spaced=True)}, f"concat(substring(w.body, 1, 2), {check}, substring(w.body, 5))", "w")
    person = f"CASE WHEN q.shown rlike '[\\\\p{{IsCyrillic}}]' THEN {spelled('cyrillic')} WHEN q.shown rlike '[\\\\p{{IsGreek}}]' THEN {spelled('greek')} ELSE {spelled('latin')} END"
    same = _scrambled("q.shown", "q.seed", spaced=True)
    made = f"CASE q.kind WHEN '' THEN q.shown WHEN 'email' THEN {email} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} WHEN 'ip' THEN {ip} WHEN 'iban' THEN {iban} WHEN 'ssn' THEN {same} ELSE initcap({person}) END"
    return _let({"kind": f"{unit}.kind", "canon": f"{unit}.canon", "shown": f"{unit}.shown", "attempt": attempt, "seed": seed}, made.replace(host, "q.host"), "q").replace("named_struct('kind'", f"named_struct('host', {host}, 'kind'", 1)


def _canonical(unit: str) -> str:
    """SQL: the canonical form that a replacement text has for its kind."""
    return f"CASE WHEN {unit}.kind IN ('card', 'ssn') THEN regexp_replace({unit}.made, '[^0-9]', '') WHEN {unit}.kind = 'phone' THEN regexp_replace({unit}.made, '[^0-9+]', '') WHEN {unit}.kind = 'iban' THEN replace({unit}.made, chr(32), '') ELSE lower({unit}.made) END"


def with_entities(docs: DataFrame, text: str = "text", into: str = "_units") -> DataFrame:
    """docs plus `_mentions`, `_pattern` that finds them, and an array, one element per mention, of that mention's units."""
    whole = f"cast(`{text}` AS string)"
    found = docs.withColumn("_found", F.expr(f"regexp_extract_all({whole}, {_quote(ALL)}, 0)")).withColumn("_parts", F.expr(_parts()))
    names = r"|(?<![\p{L}0-9])(?:"  # longer parts before those that begin them
    bare = f"concat({_quote(ALL + names)}, array_join(sort_array(array_distinct(_parts.part), false), '|'), {_quote(r')(?![\p{L}0-9])')})"
    rows = found.withColumn("_pattern", F.expr(f"CASE WHEN size(_parts) > 0 THEN {bare} END"))
    rows = rows.withColumn("_mentions", F.expr(f"CASE WHEN _pattern IS NULL THEN _found ELSE regexp_extract_all({whole}, _pattern, 0) END"))
    return rows.withColumn(into, F.expr(f"transform(_mentions, m -> {_units('m')})"))


def attempts_of(docs: DataFrame, key: str = KEY) -> DataFrame | None:
    """Entities (kind, canon) past their first attempt, or None if there are none."""
    units = with_entities(docs.select("text")).filter("size(_mentions) > 0").select(F.explode(F.flatten("_units")).alias("u")).filter("u.kind <> ''")
    entities = units.groupBy("u.kind", "u.canon").agg(F.min("u.shown").alias("shown"))
    state = materialize(entities.withColumn("attempt", F.lit(0)))
    for _ in range(ROUNDS):
        made = state.select("*", F.expr(_surrogate("named_struct('kind', kind, 'canon', canon, 'shown', shown)", "attempt", key)).alias("made"))
        made = made.withColumn("new", F.expr(_canonical("named_struct('kind', kind, 'made', made)")))
        first = made.groupBy(F.col("kind").alias("k"), F.col("new").alias("n")).agg(F.min("canon").alias("winner"), F.count("*").alias("claims"))
        doubled = made.join(first.filter("claims > 1"), (F.col("kind") == F.col("k")) & (F.col("new") == F.col("n")) & (F.col("canon") != F.col("winner")), "left_semi").select("kind", "canon")
        real = made.join(state.select(F.col("kind").alias("k"), F.col("canon").alias("c")), (F.col("kind") == F.col("k")) & (F.col("new") == F.col("c")), "left_semi").select("kind", "canon")
        losers = materialize(doubled.union(real).distinct())
        if losers.isEmpty():
            moved = state.filter("attempt > 0").select("kind", "canon", "attempt")
            return None if moved.isEmpty() else moved
        state = materialize(state.join(losers.withColumn("lost", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", "shown", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt")))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The columns of docs with `text` rewritten, plus `_n_entities`, an array of the kinds found."""
    names = docs.columns
    flat = docs.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"_c{i}") for i, c in enumerate(names)))
    moved = attempts_of(flat, key)
    rows = with_entities(flat)
    if moved is None:
        attempt = "0"
    else:
        rows = rows.withColumn("_hash", F.sha2("text", 256))
        asked = rows.filter("size(_mentions) > 0").select("_hash", F.explode(F.flatten("_units")).alias("u")).select("_hash", "u.kind", "u.canon").distinct()
        later = asked.join(moved, ["kind", "canon"]).groupBy("_hash").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("_later"))
        rows = rows.join(later, "_hash", "left")
        attempt = "coalesce(_later[concat_ws('|', u.kind, u.canon)], 0)"
    made = f"transform(_units, us -> array_join(transform(us, u -> {_surrogate('u', attempt, key)}), ''))"
    rows = rows.withColumn("_made", F.when(F.size("_mentions") > 0, F.expr(made)))
    around = f"(CASE WHEN _pattern IS NULL THEN split(cast(text AS string), {_quote(ALL)}, -1) ELSE split(cast(text AS string), _pattern, -1) END)"
    joined = f"array_join(zip_with({around}, _made, (p, m) -> concat(p, coalesce(m, ''))), '')"
    text = F.when(F.size("_mentions") > 0, F.expr(joined)).otherwise(F.col("text"))
    kinds = F.expr("transform(_units, us -> CASE WHEN us[0].kind IN ('', 'surname', 'given_m', 'given_f', 'given_n') THEN 'name' ELSE us[0].kind END)")
    return rows.select(*((text if c == "text" else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)), F.coalesce(kinds, F.array()).alias("_n_entities"))


def without_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    return replace_pii(docs, key).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_n_entities", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", "text", F.size("_n_entities").cast("long").alias("n_entities"), *(count(k) for k in PATTERNS))
