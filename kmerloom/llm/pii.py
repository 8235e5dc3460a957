"""PII surrogates, by DataFrame functions alone.

Entities are found by one pattern, in one pass over the texts; texts with names are then read again for the same persons without
their titles. Every mention is brought to a canonical form (digits of a number, an address in lower case, a person's given and
family name apart), and every distinct form gets a surrogate drawn from a keyed digest of it: the same entity always has the same one
(coreference, however it is written), of its own type, script and gender, with the validity of its check digits. Surrogates are
then checked: two entities must not share one, and none may be an entity of the corpus; those that fail are drawn again, longer
after some attempts, until none fails. Each mention is written in its own format again, and the texts
with entities are put together from the parts between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# What counts as an entity (Java patterns), by kind; the first that fits an entity names its kind.
MALE = "Mr|Mister|Sir|Herr|Herrn|Señor|Sr|Don|Monsieur|Signor|г-н"
FEMALE = "Mrs|Ms|Miss|Lady|Madam|Frau|Señora|Señorita|Sra|Doña|Madame|Mademoiselle|Mme|Mlle|Signora|г-жа"
NEUTRAL = "Dr|Prof|Professor|Doctor|Mx|Rev|д-р"
TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]+){0,20}\.\p{L}{2,}",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+?[0-9]{0,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])",
    "name": rf"(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
_PERSON = rf"^(?:(?:{TITLES})\.? )?(?:(\p{{Lu}}\p{{Ll}}+) )?(\p{{Lu}}\p{{Ll}}+)$"
#: Of an international number: its country, which stays.
_COUNTRY = r"^\+(?:1|7|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]|[0-9]{2})"
# Given names by gender and script, and the letters that stand for each other.
GIVEN = {
    ("m", "latin"): "Adam Alan Boris Carl David Eric Felix George Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor Walter".split(),
    ("f", "latin"): "Alice Anna Bella Clara Diana Emma Eva Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Фёдор".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Софья".split(),
}
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HOSTS = ("example.com", "example.net", "example.org")


SYLLABLES = {
    "latin": "ba bel ber dal den dor fan fer gar gol hal han kel ker lam lin mar mel nor pal rin ros san tor vel win".split(),
    "cyrillic": "ба бел бер вал вер гор дан дор жар зор кал кер лам лин мар мел нор пал рин рос сан тор фел хор".split(),
}
ENDINGS = {("m", "latin"): ("son", "er", "ton", "ley"), ("m", "cyrillic"): ("ов", "ин", "ев")}


def _draw(digest: Column, place: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(place) if isinstance(place, int) else place), F.lit(n)).cast("int")


def _one_of(digest: Column, place: int, values: list[str] | tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _draw(digest, place, len(values)) + 1)


def _alike(text: Column, digest: Column, keep: int = 0) -> Column:
    """text with every letter and digit after the first keep characters drawn anew from its own alphabet."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for letters in reversed(ALPHABETS):
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), _draw(digest, i, len(letters)) + 1, F.lit(1))).otherwise(out)
        return F.when((c == "") | (i < keep), c).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, of a text of digits."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(_luhn_term(c.cast("int"), i))), F.lit(0), lambda a, x: a + x
    ) % 10


def _luhn_term(d: Column, i: Column) -> Column:
    twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.when(i % 2 == 1, twice).otherwise(d)


def _rest97(text: Column) -> Column:
    """A text of digits and capitals, letters as 10 to 35, modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        letter = F.instr(F.lit(ALPHABETS[2]), c)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).when(c == "", rest).otherwise((rest * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def canonical(kind: Column, mention: Column) -> Column:
    """What is the same in all ways of writing an entity."""
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "phone", F.regexp_replace(mention, "[^0-9+]", "")).when(kind.isin("card", "ssn"), F.regexp_replace(mention, "[^0-9]", "")).otherwise(mention)
    )


def surrogate(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """A canonical entity's surrogate at an attempt, canonical too; from the fourth attempt on it is longer than its format asks.

    Kinds are those of KINDS, with a person's family name (``family``) and given name (``given``, ``gender:name``) apart.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string")), 256)
    more = F.when(attempt >= 4, _alike(F.lit("00000000"), F.concat(digest, F.lit("+")))).otherwise(F.lit(""))
    email = F.concat(_alike(F.substring_index(entity, "@", 1), digest), more, F.lit("@"), _one_of(digest, -1, HOSTS))
    ip = F.concat_ws(".", *(_draw(digest, -2 - k, 256).cast("string") for k in range(4)))
    body = _alike(F.substring(entity, F.lit(1), F.length(entity) - 1), digest, 1)
    check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    card = F.concat(body, F.when(_luhn(entity) == 0, check).otherwise(_one_of(digest, -7, tuple(ALPHABETS[0]))), more)
    plus = F.regexp_extract(entity, _COUNTRY, 0)
    phone = F.concat(plus, _alike(F.substring(entity, F.length(plus) + 1, F.length(entity)), digest), more)
    country, account = F.substring(entity, 1, 2), F.concat(_alike(F.substring(entity, F.lit(5), F.length(entity)), digest), more)
    digits = F.lpad((98 - _rest97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    good = _rest97(F.concat(F.substring(entity, F.lit(5), F.length(entity)), F.substring(entity, 1, 4))) == 1
    iban = F.concat(country, F.when(good, digits).otherwise(_alike(F.substring(entity, 3, 2), digest)), account)
    bare = F.regexp_extract(entity, "^(?:[mfu]:)?(.*)$", 1)
    gender = F.when(F.startswith(entity, F.lit("f:")), "f").when(F.startswith(entity, F.lit("m:")), "m").otherwise(_one_of(digest, -9, ("m", "f")))
    script = F.when(F.rlike(bare, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    given, family = F.lit(""), F.lit("")
    for (g, s), names in GIVEN.items():
        twice = F.concat(_one_of(digest, -8, names), F.when(attempt >= 2, F.concat(F.lit("-"), _one_of(digest, -10, names))).otherwise(F.lit("")))
        given = F.when((gender == g) & (script == s), twice).otherwise(given)
    for s, syllables in SYLLABLES.items():
        body = F.initcap(F.concat(*(_one_of(digest, -20 - k, syllables) for k in range(2))))
        longer = F.concat(body, *(F.when(attempt >= k, _one_of(digest, -22 - k, syllables)).otherwise(F.lit("")) for k in (1, 2, 4, 6, 8)), _one_of(digest, -19, ENDINGS["m", s]))
        family = F.when(script == s, F.concat(longer, F.when((F.lit(s) == "cyrillic") & F.endswith(bare, F.lit("а")), "а").otherwise(""))).otherwise(family)
    letters = F.translate(F.when(attempt >= 4, more), ALPHABETS[0], "abcdefghij")
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban)
        .when(kind == "given", F.concat(given, F.coalesce(letters, F.lit("")))).when(kind == "family", F.concat(family, F.coalesce(letters, F.lit("")))).otherwise(F.concat(_alike(entity, digest), more))
    )


def written(kind: Column, mention: Column, value: Column) -> Column:
    """A surrogate in the format of a mention: its separators, or its case."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(F.regexp_replace(mention, "[^0-9]", ""))

    def digit(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when((c >= "0") & (c <= "9"), F.substring(digits, place, F.lit(1))).otherwise(c)

    number = F.concat(F.array_join(F.transform(F.split(mention, ""), digit), ""), F.substring(digits, n + 1, F.length(digits)))
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    own = F.substring_index(mention, "@", 1)

    def cased(c: Column, i: Column) -> Column:
        model = F.substring(own, i + 1, F.lit(1))
        return F.when((F.upper(model) == model) & (F.lower(model) != model), F.upper(c)).otherwise(c)

    email = F.concat(F.array_join(F.transform(F.split(local, ""), cased), ""), F.lit("@"), host)
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "email", email).otherwise(value)


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([x for x in KINDS.items() if x[0] != "name"]):
        out = F.when(F.rlike(entity, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(out)
    return F.when(F.rlike(entity, F.lit("^[^0-9@]+$")), F.lit("name")).otherwise(out)


def surrogates(scratch: Scratch, entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for each distinct (kind, entity), with no surrogate shared and none an entity."""
    wanted = scratch.save(entities.select("kind", "entity").distinct(), "entities")
    open_ = wanted.withColumn("attempt", F.lit(0))
    taken = wanted.select(F.regexp_replace("entity", "^[mfu]:", "").alias("surrogate")).distinct()
    settled: DataFrame | None = None
    k = 0
    while True:
        drawn = scratch.save(open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), key, F.col("attempt"))), f"drawn{k}")
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("first"))  # who keeps a shared one
        known = taken if settled is None else taken.union(settled.select("surrogate")).distinct()
        judged = (
            drawn.join(first, "surrogate").join(known.withColumn("taken", F.lit(True)), "surrogate", "left")
            .withColumn("good", F.col("taken").isNull() & (F.struct("kind", "entity") == F.col("first")))
            .select("kind", "entity", "attempt", "surrogate", "good")
        )
        judged = scratch.save(judged, f"judged{k}")
        scratch.drop(f"drawn{k}")
        good = judged.where("good").select("kind", "entity", "surrogate")
        settled = good if settled is None else settled.union(good)
        open_ = judged.where("not good").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        k += 1
        if not open_.head(1):
            return settled


#: An entity with more than this share of all mentions is joined by broadcast; there are at most so many of them.
_HOT = 1000


def _with_surrogates(scratch: Scratch, each: DataFrame, table: DataFrame) -> DataFrame:
    """each with the surrogate of its (kind, entity); those with many mentions, fewer than _HOT entities, don't meet in a task."""
    counts = scratch.save(each.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    much = F.col("n") * _HOT > max(total, _HOT)
    found = table.join(counts, ["kind", "entity"])
    hot = F.broadcast(found.where(much).drop("n"))  # fewer than _HOT rows: each has more than that part of all
    some = each.join(F.broadcast(counts.where(much).select("kind", "entity").withColumn("hot", F.lit(True))), ["kind", "entity"], "left")
    return some.where("hot").drop("hot").join(hot, ["kind", "entity"]).unionByName(some.where("hot is null").drop("hot").join(found.where(~much).drop("n"), ["kind", "entity"]))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", with_originals: bool = False) -> DataFrame:
    """A row per input row: id, text (with surrogates), n_entities, and entities, an array of (kind, surrogate) in the order of the text;
    with_originals adds what each stands for, for audits only.

    A person named with a title is also found without it in the same text, by family name or by given and family name; a given name's gender is
    that of a title it stands with in the text, or drawn. Texts without entities stay as they are; a null text stays null with no
    entities; null ids stay null; repeated rows get the same surrogates; an empty table gives an empty result; other columns are not
    read. Texts are read once more only where they have names, and only texts with entities are shuffled. key: whoever has it can tell which
    surrogate an entity gets.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    fields = ("kind", "entity", "surrogate") if with_originals else ("kind", "surrogate")
    pattern = "|".join(f"(?:{p})" for p in KINDS.values())
    text = F.col(text_col)
    some = F.rlike(text, F.lit(rf"[0-9@]|(?:{TITLES})\.? \p{{Lu}}"))
    found = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = scratch.save(
        docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"), found.alias("_found")).withColumn("_any", F.coalesce(F.size("_found"), F.lit(0)) > 0), "rows"
    )

    def person(e: Column) -> Column:
        title = F.regexp_extract(e, rf"^({TITLES})\.? ", 1)
        gender = F.when(F.rlike(title, F.lit(f"^(?:{FEMALE})$")), "f").when(F.rlike(title, F.lit(f"^(?:{MALE})$")), "m")
        return F.struct(gender.alias("gender"), F.regexp_extract(e, _PERSON, 1).alias("given"), F.regexp_extract(e, _PERSON, 2).alias("family"))

    def people(found: Column) -> Column:
        return F.transform(F.filter(found, lambda e: F.rlike(e, F.lit(_PERSON))), person)

    def any_of(names: Column) -> Column:
        return F.array_join(F.array_distinct(F.filter(names, lambda n: n != "")), "|")

    first = rows.where("_any").select("_row", "_id", "_text", "_found", people(F.col("_found")).alias("_people"))
    given, family = any_of(F.col("_people.given")), any_of(F.col("_people.family"))
    bare = F.concat(F.lit(r"|(?<![\p{L}])(?:(?:"), given, F.lit(") )?(?:"), family, F.lit(r")(?![\p{L}])"))
    named = first.where(F.size("_people") > 0).withColumn("_pattern", F.concat(F.lit(pattern), bare))
    named = named.withColumn("_found", F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))).withColumn("_parts", F.split("_text", F.col("_pattern"), F.lit(-1)))
    plain = first.where(F.size("_people") == 0).withColumn("_parts", F.split("_text", pattern, -1))
    split = named.drop("_pattern", "_text").unionByName(plain.drop("_text"))
    known = F.col("_people")

    def mention(e: Column) -> Column:
        kind, own = kind_of(e), person(e)
        told = F.get(F.transform(F.filter(known, lambda k: (k["given"] == own["given"]) & k["gender"].isNotNull()), lambda k: k["gender"]), F.lit(0))
        of = F.struct(F.coalesce(own["gender"], told, F.lit("u")).alias("gender"), own["given"].alias("given"), own["family"].alias("family"))
        return F.struct(kind.alias("kind"), e.alias("entity"), F.when(kind == "name", of).alias("person"))

    with_any = scratch.save(split.select("_row", "_id", "_parts", F.transform("_found", mention).alias("_found")), "mentions")

    def needs(m: Column, i: Column) -> Column:
        one = lambda k, kind, e: F.struct((i * 2 + k).alias("_at"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), e.alias("entity"))
        of = m["person"]
        parts = F.array(one(0, "family", of["family"]), one(1, "given", F.when(of["given"] != "", F.concat(of["gender"], F.lit(":"), of["given"]))))
        return F.when(m["kind"] == "name", parts).otherwise(F.array(one(0, m["kind"], canonical(m["kind"], m["entity"]))))

    each = with_any.select("_row", F.explode(F.flatten(F.transform("_found", needs))).alias("_e")).select("_row", "_e.*").where("entity is not null")
    table = surrogates(scratch, each, key)
    drawn = _with_surrogates(scratch, each, table).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_at", "surrogate"))).alias("_of"))

    def replaced(m: Column, i: Column) -> Column:
        title = F.regexp_extract(m["entity"], rf"^(?:{TITLES})\.? ", 0)
        given = F.coalesce(F.concat(F.try_element_at("_of", i * 2 + 1), F.lit(" ")), F.lit(""))
        value = F.try_element_at("_of", i * 2)
        return F.struct(m["kind"].alias("kind"), m["entity"].alias("entity"), F.when(m["kind"] == "name", F.concat(title, given, value)).otherwise(written(m["kind"], m["entity"], value)).alias("surrogate"))

    changed = with_any.join(drawn, "_row").withColumn("_e", F.transform("_found", replaced))
    new = F.array_join(F.zip_with("_parts", "_e", lambda part, e: F.concat(part, F.coalesce(e["surrogate"], F.lit("")))), "")
    entities = F.transform("_e", lambda e: F.struct(*(e[f].alias(f) for f in fields)))
    changed = changed.select(F.col("_id").alias(id_col), new.alias(text_col), F.size("_e").cast("long").alias("n_entities"), entities.alias("entities"))
    none = F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")
    same = rows.where("not _any").select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.lit(0).cast("long").alias("n_entities"), none.alias("entities"))
    return changed.unionByName(same)
