"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are found by one search of each text, gathered over the whole corpus in a canonical form and
given keyed replacements (HMAC of the canonical form) of the same type, gender, script and format.
Collisions (two entities with one surrogate, or a surrogate that some document holds as a real entity) are
found by joins and redrawn until none is left, from a space that grows with the attempts, so distinct
entities stay distinct and one entity is replaced alike wherever and however it is written.

A person's given name and surname are entities of their own and the title stays: ``Mr. John Smith``,
``Mr. Smith`` and ``Dr. Smith`` keep one surrogate surname, ``Mr. Smith`` and ``Mrs. Smith`` stay apart.
Persons are known by a title or by a given name of :data:`GIVEN`; bare surnames are not looked for.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import bucket_count, kept, materialize, release, row_key, tables

# Titles and given names by gender and script, and the syllables of surrogate surnames.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"], "n": ["Dr", "Prof"]}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Karl Jürgen Wolfgang Pierre Jean Michel François Carlos José Juan Miguel Pedro".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Laura Anna Ursula Monika Sabine Renate Marie Sophie Camille Nathalie Carmen Lucía Isabel Elena Ana".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Павел Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
}
SYLLABLES = {
    "latin": "bar bel cor dan del fer gar hol kel lan mar mel nor pel ran rol sen tor val win".split(),
    "cyrillic": "бар бел вал гор дан зор кар лан мар мел нор пав ран рос сев тар тор фед чер шал".split(),
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_GREEK, _CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"

#: Kinds of one group each, in the order in which they are tried.
KINDS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+(?<=\.\p{L}[\p{L}\p{N}-]{1,62})",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\p{N})",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "phone": r"(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?!\p{N})|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?!\p{N}))",
    "card": r"(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})(?!\p{N})",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
}
_SURNAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_NAMES = "|".join(n for ns in GIVEN.values() for n in ns)
_TITLE = "|".join(rf"((?:{'|'.join(ts)})\.? )" for ts in TITLES.values())
_PERSON = rf"(?:(?:{_TITLE})(?:(\p{{Lu}}\p{{Ll}}+) )?({_SURNAME})|({_NAMES}) ({_SURNAME}))(?!\p{{L}})"
#: Entities start where no letter or digit stands before; what a character cannot start is not tried there.
PATTERN = (
    rf"(?<![\p{{L}}\p{{N}}])(?:({KINDS['email']})|(?=[0-9+(])(?:{'|'.join(f'({KINDS[k]})' for k in ('ip', 'ssn', 'phone', 'card'))})"
    rf"|(?=\p{{Lu}})(?:({KINDS['iban']})|{_PERSON}))"
)
#: Groups of the pattern: the kinds, titles m, f and n, given name and surname after a title, and without one.
GROUPS = 13
#: Attempts after which the space of a kind of fixed length grows by a character, and again.
PATIENCE = 6


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _marks(key: bytes) -> tuple[str, str, str]:
    """Opening, field and closing marks that no text holds: they depend on the key."""
    tag = hmac.new(key, b"marks", hashlib.sha256).hexdigest()[:16]
    return f"\x02{tag}", f"\x1f{tag}", f"\x03{tag}"


def _entity(lead: Column, kind: str | Column, gender: str | Column, value: Column) -> Column:
    name = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(lead.alias("lead"), name(kind).alias("kind"), name(gender).alias("gender"), value.alias("value"))


def _entities_of(fields: Column, lead: Column) -> Column:
    """The entities of one match, each with the text that stands before it."""
    title = F.concat(fields[6], fields[7], fields[8])
    given, surname = F.concat(fields[9], fields[11]), F.concat(fields[10], fields[12])
    listed = {g: F.lower(given).isin([n.lower() for (_, x), ns in GIVEN.items() if x == g for n in ns]) for g in "mf"}
    gender = F.when(fields[6] != "", "m").when(fields[7] != "", "f").when(listed["m"], "m").when(listed["f"], "f").otherwise("n")
    kind, value = F.lit("email"), fields[0]
    for i, name in enumerate(KINDS):
        kind, value = F.when(fields[i] != "", name).otherwise(kind), F.when(fields[i] != "", fields[i]).otherwise(value)
    plain = F.array(_entity(lead, kind, "n", value))
    short = F.array(_entity(F.concat(lead, title), "surname", "n", surname))
    full = F.array(_entity(F.concat(lead, title), "given", gender, given), _entity(F.lit(" "), "surname", "n", surname))
    return F.when(surname == "", plain).when(given == "", short).otherwise(full)


def find(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with ``__v_ents``, the entities in order (lead, kind, gender, value), ``__v_tail`` and ``__v_n``.

    ``__v_n`` counts matches; null or entity-free text has none and no entities. Each text is searched once.
    """
    opened, field, closed = _marks(key)
    marked = F.regexp_replace(F.col("text").cast("string"), PATTERN, opened + field.join(f"${i + 1}" for i in range(GROUPS)) + closed)
    rows = docs.withColumn("__v_pieces", F.split(marked, opened))
    halves = F.transform(F.slice("__v_pieces", F.lit(2), F.size("__v_pieces")), lambda p: F.split(p, closed, 2))
    rows = rows.withColumn("__v_halves", F.when(F.size("__v_pieces") > 1, halves))

    def entities(halves: Column) -> Column:
        leads = F.concat(F.array(F.col("__v_pieces")[0]), F.transform(halves, lambda h: h[1]))
        return _let(leads, lambda before: F.flatten(F.transform(halves, lambda h, i: _let(F.split(h[0], field), lambda f: _entities_of(f, F.get(before, i))))))

    made = {"__v_ents": F.when(F.col("__v_halves").isNotNull(), entities(F.col("__v_halves"))), "__v_tail": F.element_at("__v_halves", -1)[1], "__v_n": F.coalesce(F.size("__v_halves"), F.lit(0))}
    return rows.withColumns(made).withColumn("__v_n", F.greatest("__v_n", F.lit(0)).cast("long")).drop("__v_pieces", "__v_halves")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def canonical(kind: Column, value: Column) -> Column:
    """How an entity is compared: case and separators do not count."""
    compact = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    return F.when(kind.isin("email", "given", "surname"), F.lower(value)).when(kind == "ip", value).when(kind == "iban", compact).otherwise(_digits(value))


def keyed_stream(key: bytes, message: Column, numbers: Column) -> Column:
    """An array of at least so many numbers, four hex digits each, from HMAC-SHA256 blocks of ``message``."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)

    def block(i: Column) -> Column:
        said = F.encode(F.concat_ws("|", i.cast("string"), message), "utf-8")
        return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), said), 256))), 256)

    blocks = F.transform(F.sequence(F.lit(0), F.floor(numbers / 16).cast("int")), block)
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit("[0-9a-f]{4}"), F.lit(0))))


def _draw(stream: Column, i: Column, n: int) -> Column:
    """The ``i``-th number of a stream, below ``n``."""
    return F.conv(F.get(stream, i.cast("int")), 16, 10).cast("int") % n


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), (n + 1).cast("int"), F.lit(1))


def _same_class(char: Column, stream: Column, i: Column) -> Column:
    """A drawn character of the same class and script; others stay."""
    lower = (
        F.when(F.lower(char).rlike(f"[{_CYRILLIC}ё]"), _pick(_CYRILLIC, _draw(stream, i, len(_CYRILLIC))))
        .when(F.lower(char).rlike("[α-ωά-ώ]"), _pick(_GREEK, _draw(stream, i, len(_GREEK))))
        .otherwise(_pick(_LETTERS, _draw(stream, i, 26)))
    )
    return (
        F.when(char.rlike("[0-9]"), _draw(stream, i, 10).cast("string"))
        .when(char.rlike(r"\p{Lu}"), F.upper(lower))
        .when(char.rlike(r"\p{L}"), lower)
        .otherwise(char)
    )


def _rewrite(text: Column, stream: Column, keep_to: Column, keep_from: Column) -> Column:
    """Characters of ``text`` redrawn by class but for the first ``keep_to`` and those from ``keep_from`` (0-based)."""
    redrawn = lambda k: F.transform(F.split(text, ""), lambda c, i: F.when((i < k["a"]) | (i >= k["b"]), c).otherwise(_same_class(c, stream, i)))
    return F.array_join(_let(F.struct(keep_to.alias("a"), keep_from.alias("b")), redrawn), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, (n - i).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def surrogate(key: bytes, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of a canonical entity on an attempt, from a space that grows with attempts."""
    wider = F.floor(attempt / PATIENCE).cast("int")
    stream = keyed_stream(key, F.concat_ws("|", kind, canon, gender, attempt.cast("string")), F.length(canon) + attempt + 24)

    def made(stream: Column) -> Column:
        longer = F.concat(canon, F.repeat(F.lit("0"), wider))
        n = F.length(longer)
        drawn = _rewrite(longer, stream, F.lit(1), n)
        body = F.substr(drawn, F.lit(1), (n - 1).cast("int"))
        check = F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
        card = F.when(_luhn_sum(canon) % 10 == 0, F.concat(body, check)).otherwise(drawn)
        octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(stream, i, 223) + 1).cast("string"))
        address = F.concat(F.repeat(F.lit("a"), wider), canon)
        email = _rewrite(address, stream, F.lit(0), F.length(address) - F.length(F.regexp_extract(canon, r"\.[^.]*$", 0)))
        cyrillic = canon.rlike(r"\p{IsCyrillic}")

        def spoken(script: str, first: int, several: Column) -> Column:
            parts = F.array(*[F.lit(s) for s in SYLLABLES[script]])
            return F.array_join(F.transform(F.sequence(F.lit(first), several + first - 1), lambda i: F.element_at(parts, _draw(stream, i, len(SYLLABLES[script])) + 1)), "")

        def surname(script: str) -> Column:
            one = spoken(script, 0, 3 + attempt)
            return F.when(canon.contains("-"), F.concat(one, F.lit("-"), spoken(script, 12, 2 + F.least(attempt, F.lit(2))))).otherwise(one)

        def given(script: str) -> Column:
            lists = {"m": GIVEN[(script, "m")], "f": GIVEN[(script, "f")]}
            lists["n"] = lists["m"] + lists["f"]
            out = F.lit(None).cast("string")
            for g, names in lists.items():
                pick = lambda i, names=names: F.element_at(F.array(*[F.lit(x.lower()) for x in names]), _draw(stream, F.lit(i), len(names)) + 1)
                second = F.when(attempt < 4, "").when(attempt < 8, F.concat(F.lit("-"), pick(1))).otherwise(F.concat(F.lit("-"), spoken(script, 2, attempt - 6)))
                out = F.when(gender == g, F.concat(pick(0), second)).otherwise(out)
            return out

        by_script = lambda f: F.when(cyrillic, f("cyrillic")).otherwise(f("latin"))
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "surname", by_script(surname))
            .when(kind == "given", by_script(given))
            .when(kind == "iban", _rewrite(longer, stream, F.lit(2), n))
            .when(kind == "card", card)
            .when(kind == "phone", drawn)
            .otherwise(_rewrite(longer, stream, F.lit(0), n))
        )

    return _let(stream, made)


def render(kind: Column, value: Column, made: Column) -> Column:
    """A surrogate in the format of ``value``: its separators, its capitals; what is longer follows at the end."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["s"], F.substr(made, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))
    )
    fill = F.aggregate(F.split(value, ""), start, step, lambda a: F.concat(a["s"], F.substr(made, a["i"], F.length(made))))
    extra = F.greatest(F.length(made) - F.length(value), F.lit(0))  # characters that a wider space has put in front
    letters = lambda k: F.transform(F.split(made, ""), lambda c, i: F.when((i >= k["n"]) & F.get(k["old"], F.greatest(i - k["n"], F.lit(0)).cast("int")).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    cased = F.array_join(_let(F.struct(F.split(value, "").alias("old"), extra.cast("int").alias("n")), letters), "")
    name = F.array_join(F.transform(F.split(made, "-"), F.initcap), "-")
    return F.when(kind == "email", cased).when(kind == "ip", made).when(kind.isin("given", "surname"), name).otherwise(fill)


def surrogates(entities: DataFrame, key: bytes, draw: Callable = surrogate) -> DataFrame:
    """``(kind, canon, gender, surrogate)`` for the distinct ``entities(kind, canon, gender)``, as a table.

    Of entities drawn to one surrogate the first (by attempt, then canonical form) keeps it; the others draw
    again, and so do those whose surrogate is a real entity (a given name only if it is the person's own).
    Given names of unknown gender go with the same name of a known one. Each attempt's space is at least as
    large as the one before and grows without bound, so the rounds end.
    """
    known = Window.partitionBy("kind", "canon")
    distinct = entities.select("kind", "canon", "gender").distinct()
    alike = F.when(F.col("gender") == "n", F.coalesce(F.min(F.when(F.col("gender") != "n", F.col("gender"))).over(known), F.lit("n"))).otherwise(F.col("gender"))
    with tables():
        every = materialize(distinct.withColumn("as_gender", alike), "entities")
        real = every.select("kind", "canon", F.col("as_gender").alias("gender")).distinct()
        parts = bucket_count(every.count(), 2048)
        new = draw(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"))
        held = materialize(real.repartition(parts, "kind", "canon").withColumn("attempt", F.lit(0)).withColumn("surrogate", new), "surrogates")
        taken = every.select(F.col("kind").alias("r_kind"), F.col("canon").alias("r_canon")).distinct()
        while True:
            first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon", "gender")
            marked = held.withColumn("turn", F.row_number().over(first))
            same = (F.col("kind") == F.col("r_kind")) & (F.col("surrogate") == F.col("r_canon"))
            own = F.col("r_canon").isNotNull() & ((F.col("kind") != "given") | (F.col("surrogate") == F.col("canon")))
            marked = marked.join(taken, same, "left").withColumn("again", (F.col("turn") > 1) | own)
            marked = materialize(marked.select("kind", "canon", "gender", "attempt", "surrogate", "again"), "surrogates")
            pending = marked.where("again").count()
            if not pending:
                break
            redrawn = marked.where("again").repartition(bucket_count(pending, 2048), "kind", "canon").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", new)
            after = materialize(marked.where(~F.col("again")).unionByName(redrawn).drop("again"), "surrogates")
            release(held)
            release(marked)
            held = after
        found = marked.select("kind", "canon", F.col("gender").alias("as_gender"), "surrogate")
        return kept(every.join(found, ["kind", "canon", "as_gender"]).select("kind", "canon", "gender", "surrogate"), "surrogates")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with each entity of ``text`` replaced, and ``n_entities``; ``key`` is the caller's secret.

    Only entities, and the texts that hold some, move between tasks. Null and empty text stay as they are
    with 0 entities; null and repeated ``doc_id`` are ordinary rows and equal rows are treated alike; a very
    long text is one row; an empty table gives no rows. Other columns pass through; an extra ``n_entities``
    is replaced.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows = docs.drop("n_entities")
    k1, k2 = row_key(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    searched = kept(find(rows.withColumns({"__v_k1": k1, "__v_k2": k2}), key), "searched")
    holding = searched.where("__v_n > 0")
    each = holding.select("__v_k1", "__v_k2", F.posexplode("__v_ents").alias("pos", "e")).select("__v_k1", "__v_k2", "pos", "e.kind", "e.gender", "e.value")
    with tables():
        every = materialize(each, "mentions")
        values = materialize(every.groupBy("kind", "gender", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("canon", canonical(F.col("kind"), F.col("value"))), "values")
        named = values.join(surrogates(values, key), ["kind", "canon", "gender"])
        forms = materialize(named.select("kind", "gender", "value", render(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")), "forms")
        # Rows that are equal share a key, hence the set.
        placed = every.join(forms, ["kind", "gender", "value"]).groupBy("__v_k1", "__v_k2").agg(F.sort_array(F.collect_set(F.struct("pos", "new"))).alias("__v_new"))
        placed = kept(placed, "placed")
    woven = F.concat(F.array_join(F.zip_with("__v_ents", "__v_new", lambda e, n: F.concat(e["lead"], n["new"])), ""), F.col("__v_tail"))
    out = [F.col(c) if c != "text" else F.col("text").cast("string").alias("text") for c in rows.columns]
    plain = searched.where("__v_n = 0").select(*out, F.col("__v_n").alias("n_entities"))
    hit = holding.join(placed, ["__v_k1", "__v_k2"]).withColumn("text", woven)
    return plain.union(hit.select(*out, F.col("__v_n").alias("n_entities")))
