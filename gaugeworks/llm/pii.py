"""Personal data replaced by keyed, type-consistent surrogates. DataFrame operations only.

Entities are found by one expression: e-mail addresses, IPv4 addresses, IBANs, payment card numbers, national numbers,
telephone numbers, and persons: one or two names after a title, or a name after one of GIVEN_NAMES. A person's entities are
the parts of the name, so that one person stays one person in "Mr. John Miller", "Dr. Miller" and "MILLER"; a family name
that a text gives with a title or a given name is also replaced where it stands alone in that text, as a whole word.

An entity's canonical form (case, spaces and separators apart) gets one surrogate everywhere. The surrogate has the entity's
kind, a name its script, and a given name the gender that its titles tell (else GIVEN_NAMES, else neither). It is drawn by a
keyed hash of the canonical form: names from lists, after two draws made of syllables, one more with each draw; card numbers
with their first and a right check digit, IBANs with their country, letters where letters stood and right check digits,
telephone numbers with the country code. Collision checks: a surrogate that another entity has drawn, that equals some entity
of the data, or that equals its own entity is drawn again with the next number, until all differ. A mention is then written
in the format of the original: separators, brackets, case, title.

Only distinct entities are shuffled for the draws. What mentions become is joined by mention; those with a MANY-th of all or
more (MANY at most) come from a broadcast table, so that no key of the join has many rows. Texts meet their replacements by
a hash of id and text.

Defined cases: null texts stay null; empty texts and texts without entities stay as they are; overlapping candidates: the
leftmost wins, then the first kind; repeated rows get equal results; very long texts are searched whole; an empty table gives
no rows; other columns pass through, but one with the name of the count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.jaccard import shared

MANY = 1024
# Titles with the gender they tell.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Sra", "Señora", "Doña", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Monsieur", "Herr", "Sr", "Señor", "Don", "Господин", "Κύριος"),
    "n": ("Dr", "Prof"),
}
# Given names that mark a person without a title, by gender; none that is a common word.
GIVEN_NAMES = {
    "f": "Alice Amanda Amelia Andrea Angela Anna Anne Barbara Beatriz Brenda Camille Carla Carmen Carol Caroline Catherine Charlotte Christine Claudia Cristina Deborah Diana Dorothy Elena Elizabeth Emily Emma Fatima Fiona Francesca Hannah Heike Helen Ingrid Irene Isabel Jane Janet Jennifer Jessica Joan Judith Julia Karen Katherine Katrin Laura Linda Lisa Louise Lucia Margaret Maria Marie Martha Mary Michelle Monica Nancy Natalie Nicole Olga Patricia Paula Rachel Rebecca Ruth Sandra Sarah Sharon Sofia Sophie Stephanie Susan Teresa Ursula Valentina Yvonne".split(),
    "m": "Adam Albert Alberto Alexander Andrew Anthony Antonio Arthur Benjamin Brian Carlos Charles Christopher Daniel David Dennis Diego Donald Edward Enrique Eric Fernando Francisco Gary George Gerald Giovanni Gregory Hans Harold Heinrich Henry Hugo James Javier Jeffrey John Jonathan Jorge Jose Joseph Joshua Juan Jürgen Karl Keith Kenneth Kevin Klaus Larry Lars Louis Luis Manuel Marco Mario Martin Matthew Michael Miguel Nicolas Nicholas Oliver Pablo Patrick Paul Pedro Peter Philip Pierre Rafael Raymond Richard Robert Roberto Roger Ronald Ryan Samuel Scott Sergio Simon Stefan Stephen Steven Thomas Timothy Walter Wolfgang".split(),
}
# Given and family names for surrogates, by gender and script.
GIVEN = {
    "f_latin": "Alba Berit Clara Dana Edda Flora Greta Hanna Ines Julia Karla Lena Mona Nora Olga Paula Rita Sonja Tessa Vera".split(),
    "m_latin": "Alan Bruno Carl Dario Emil Felix Georg Hugo Ivan Jonas Karl Leo Marc Nils Oskar Paul Ralf Stefan Theo Viktor".split(),
    "n_latin": "Alex Chris Dominique Eli Francis Gale Jamie Kim Lee Marin Noel Pat Quinn Robin Sam Toni".split(),
    "f_cyrillic": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария".split(),
    "m_cyrillic": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк".split(),
    "n_cyrillic": "Женя Саша Валя Слава".split(),
    "f_greek": "Αθηνά Βασιλική Γεωργία Δέσποινα Ελένη Ζωή Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    "m_greek": "Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λουκάς Νίκος Πέτρος".split(),
    "n_greek": "Αλέξ Γιάννι Στέφι Φάνι".split(),
}
FAMILY = {
    "latin": "Adler Bauer Castel Dorn Ebner Falk Gruber Harper Ibarra Jensen Keller Lang Moreau Nolan Ortiz Prado Quint Rossi Soler Turner Urban Vidal Weber Young Zeller".split(),
    "cyrillic": "Авдеенко Бондаренко Вдовиченко Гриценко Демченко Емельяненко Журавко Зинченко Коваленко Лысенко".split(),
    "greek": "Αγγελάκη Βλάχου Γαλάνη Δελλή Ζερβού Καλλέργη Λαζάρου Μακρή Νικολάου Ράλλη".split(),
}
# Syllables and endings of made names.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha he jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti va ve".split(),
    "cyrillic": "ба ве га да де жа за ка ла ле ли ма ме ми на не ни па ра ре ро са се та те ти ва ви".split(),
    "greek": "βα γα δα δε ζα θε κα κε λα λε λι μα με μι να νε νι πα ρα ρε ρο σα σε τα τε τι φα φι".split(),
}
ENDINGS = {
    "f_latin": "na lia ria tta sina".split(), "m_latin": "ro nus rik lan mir".split(), "n_latin": "ry lin nel".split(), "family_latin": "mann son ini ard berg nel ert".split(),
    "f_cyrillic": "на рия лина".split(), "m_cyrillic": "рик мир слав".split(), "n_cyrillic": "ша ня".split(), "family_cyrillic": "енко чук ко".split(),
    "f_greek": "να ρία λία".split(), "m_greek": "ρος νης κος".split(), "n_greek": "νι λι".split(), "family_greek": "ίδη άκη όγλου".split(),
}
#: The country codes of telephone numbers; all others have three digits.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
_TITLE = "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t)))


def _by_first(words: list[str]) -> str:
    """An alternation that looks at the first letter first; longer words before their prefixes."""
    firsts = sorted({w[0] for w in words})
    return "|".join(a + "(?:" + "|".join(sorted((w[1:] for w in words if w[0] == a), key=lambda w: (-len(w), w))) + ")" for a in firsts)


_KNOWN = _by_first(GIVEN_NAMES["f"] + GIVEN_NAMES["m"])
_NAME = r"\p{Lu}(?:'\p{Lu})?[\p{L}\p{M}]+(?:-\p{Lu}[\p{L}\p{M}]+)*"
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
    ("number", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])"),
    ("person", rf"(?<!\p{{L}})(?:(?:{_TITLE})\.?\x20{_NAME}(?:\x20{_NAME})?|(?:{_KNOWN})\x20{_NAME})"),
)
EVERY = "|".join(f"(?:{p})" for _, p in PATTERNS)
GATE = rf"[0-9@]|(?:{_TITLE})\.?\x20\p{{Lu}}|(?<!\p{{L}})(?:{_KNOWN})\x20\p{{Lu}}"
ENTITY = "array<struct<kind:string,entity:string,gender:string,word:string>>"


def kind_of(mention: Column) -> Column:
    tests = {"email": mention.contains("@"), "ip": mention.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "iban": mention.rlike("^[A-Z]{2}[0-9]{2}"), "card": mention.rlike(r"^(?:[0-9]{4}[ -]){3}[0-9]{4}$|^[0-9]{13,19}$"), "number": mention.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "phone": mention.rlike(r"^[+(0-9]"), "person": F.lit(True)}
    out = F.lit(None).cast("string")
    for kind, _ in reversed(PATTERNS):
        out = F.when(tests[kind], kind).otherwise(out)
    return out


def prefix_of(mention: Column) -> Column:
    """A person's title, its full stop and the space after it; or nothing."""
    return F.regexp_extract(mention, rf"^((?:{_TITLE})\.?\x20)", 1)


def names_of(mention: Column) -> Column:
    return F.split(F.substring(mention, F.length(prefix_of(mention)) + 1, F.length(mention)), " ")


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def entities_of(kind: Column, mention: Column) -> Column:
    """What a mention names, in canonical form: one entity, or the parts of a person's name, the family name last."""
    title = F.regexp_extract(mention, rf"^({_TITLE})\.?\x20", 1)
    gender = F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m")
    names = names_of(mention)

    def part(name: Column, kind: str, gender: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.concat(script_of(name), F.lit("_"), F.lower(name)).alias("entity"), gender.alias("gender"), name.alias("word"))

    none = F.lit(None).cast("string")
    person = F.concat(F.transform(F.slice(names, 1, F.size(names) - 1), lambda n: part(n, "given", gender)), F.array(part(F.element_at(names, -1), "family", none)))
    plain = F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(F.regexp_replace(mention, r"[^0-9+]", ""))
    other = F.array(F.struct(kind.alias("kind"), plain.alias("entity"), none.alias("gender"), none.alias("word")))
    return F.when(kind == "person", person.cast(ENTITY)).otherwise(other.cast(ENTITY))


def _letters(seed: Column, n: int) -> Column:
    return F.translate(F.substring(seed, 1, n), "0123456789abcdef", "bcdfghjklmnprstv")


def _digits(seed: Column, length: Column) -> Column:
    """Decimal digits from a hexadecimal hash, up to 128."""
    return F.substring(F.translate(F.concat(seed, F.reverse(seed)), "abcdef", "246813"), F.lit(1), length)


def _pick(seed: Column, at: Column, names: Column) -> Column:
    """One of the names, by four hexadecimal digits."""
    return F.element_at(names, (F.pmod(F.conv(F.substring(seed, at, F.lit(4)), 16, 10).cast("int"), F.size(names)) + 1).cast("int"))


def _list(of: dict[str, list[str]], name: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for k, words in of.items():
        out = F.when(name == k, F.array(*map(F.lit, words))).otherwise(out)
    return out


def _name(seed: Column, draw: Column, script: Column, group: Column) -> Column:
    """In lower case: from the list in the first two draws, then made of `draw` syllables and an ending."""
    listed = _list({**GIVEN, **{f"family_{k}": v for k, v in FAMILY.items()}}, group)
    places = F.sequence(F.lit(0), F.least(draw, F.lit(14)) - 1)
    made = F.array_join(F.transform(places, lambda i: _pick(seed, 5 + 4 * i, _list(SYLLABLES, script))), "")
    return F.lower(F.when(draw < 2, _pick(seed, F.lit(1), listed)).otherwise(F.concat(made, _pick(seed, F.lit(1), _list(ENDINGS, group)))))


def drawn(kind: Column, entity: Column, gender: Column, draw: Column, key: str) -> Column:
    """The draw-th surrogate of an entity, in canonical form."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, draw.cast("string")), 256)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    byte = lambda i: F.conv(F.substring(seed, 2 * i + 1, 2), 16, 10)
    ip = F.concat_ws(".", F.pmod(byte(0).cast("int"), F.lit(223)) + 1, byte(1), byte(2), byte(3))
    country = F.regexp_extract(entity, rf"^(\+(?:{COUNTRY}))", 1)
    phone = F.concat(country, _digits(seed, F.length(digits) - F.greatest(F.length(country) - 1, F.lit(0))))
    body = F.concat(F.substring(entity, 1, 1), _digits(seed, F.length(entity) - 2))
    card = F.concat(body, _luhn(body))
    script = F.regexp_extract(entity, "^([a-z]+)_", 1)
    group = F.concat(F.when(kind == "given", gender).otherwise("family"), F.lit("_"), script)
    name = F.concat(script, F.lit("_"), _name(seed, draw, script, group))
    email = F.concat(_letters(seed, 10), F.lit("."), _digits(F.substring(seed, 11, 20), F.lit(4)), F.lit("@"), _letters(F.substring(seed, 31, 20), 8), F.lit(".example"))
    return F.when(kind.isin("given", "family"), name).when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", _iban(entity, seed)).when(kind == "card", card).when(kind == "phone", phone).otherwise(_digits(seed, F.length(digits)))


def _luhn(body: Column) -> Column:
    """The check digit that a number with this body has."""
    places = F.sequence(F.lit(1), F.length(body))

    def worth(i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        doubled = F.pmod(F.length(body) - i, F.lit(2)) == 0
        return F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _iban(entity: Column, seed: Column) -> Column:
    """The entity's country, check digits modulo 97, and new letters and digits where there were such."""
    letters = F.array(*(F.lit(chr(65 + i)) for i in range(26)))

    def new(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(seed, F.pmod(2 * i, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int") + i
        return F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).otherwise(F.element_at(letters, F.pmod(n, F.lit(26)) + 1))

    country = F.substring(entity, 1, 2)
    body = F.array_join(F.transform(F.split(F.substring(entity, F.lit(5), F.length(entity)), ""), new), "")
    worth = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + worth(c), F.lit(97)))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _cased(word: Column, surrogate: Column) -> Column:
    """A name in capitals if the original is, else with a capital letter; without its script."""
    bare = F.regexp_replace(surrogate, "^[a-z]+_", "")
    return F.when(F.upper(word) == word, F.upper(bare)).otherwise(F.initcap(bare))


def written(kind: Column, mention: Column, parts: Column) -> Column:
    """A mention's text. parts: its entities in order, as structs of word and surrogate (canonical)."""
    surrogate = F.get(parts, F.lit(0))["surrogate"]
    plain = F.regexp_replace(mention, r"[^0-9A-Z+]", "")
    # each digit or letter of the mention takes the next character of the surrogate; all else stays
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def step(state: Column, c: Column) -> Column:
        counts = c.rlike("[0-9A-Z+]")
        return F.struct((state["at"] + F.when(counts, 1).otherwise(0)).alias("at"), F.concat(state["text"], F.when(counts, F.substring(surrogate, state["at"], F.lit(1))).otherwise(c)).alias("text"))

    filled = F.aggregate(F.split(mention, ""), start, step, lambda s: s["text"])
    person = F.concat(prefix_of(mention), F.array_join(F.transform(parts, lambda p: _cased(p["word"], p["surrogate"])), " "))
    email = F.when((F.upper(mention) == mention), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "person", person).when(kind == "email", email).when(kind == "ip", surrogate).when(F.length(plain) == F.length(surrogate), filled).otherwise(surrogate)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: kind, entity (distinct), gender. Adds `surrogate`: no two alike, none of them an entity or its own."""
    now = shared(entities.select("kind", "entity", "gender", F.lit(0).alias("draw")))
    while True:
        tried = now.withColumn("surrogate", drawn(F.col("kind"), F.col("entity"), F.col("gender"), F.col("draw"), key))
        first = tried.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "entity")).alias("first"), F.count("*").alias("n"))
        taken = entities.select("kind", F.col("entity").alias("surrogate")).withColumn("taken", F.lit(True))
        bad = first.join(taken, ["kind", "surrogate"], "left").filter("n > 1 or taken").select("kind", "surrogate", F.col("first.entity").alias("first"), F.coalesce("taken", F.lit(False)).alias("taken"))
        again = shared(tried.join(bad, ["kind", "surrogate"]).filter("taken or entity <> first").select("kind", "entity", F.lit(True).alias("again")))
        if again.isEmpty():
            return tried.select("kind", "entity", "surrogate")
        now = shared(now.join(again, ["kind", "entity"], "left").select("kind", "entity", "gender", (F.col("draw") + F.when(F.col("again"), 1).otherwise(0)).alias("draw")))


def gender_of(entity: Column, f: Column, m: Column) -> Column:
    """A given name's: that of its titles; without one, or with both, that of GIVEN_NAMES."""
    listed = F.lit("n")
    for g, names in GIVEN_NAMES.items():
        listed = F.when(entity.isin(*(f"latin_{n.lower()}" for n in names)), g).otherwise(listed)
    return F.when(f & ~m, "f").when(m & ~f, "m").otherwise(listed)


def mentions_of(text: Column) -> Column:
    """The mentions in a text, in order."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(EVERY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """mention, said, and word and new of the family name (or null). mentions: mention, distinct."""
    kind = kind_of(F.col("mention"))
    parts = shared(mentions.select("mention", kind.alias("kind")).select("mention", F.posexplode(entities_of(F.col("kind"), F.col("mention"))).alias("at", "part")).select("mention", "at", "part.*"))
    titled = lambda g: F.coalesce(F.bool_or(F.col("gender") == g), F.lit(False))
    entities = parts.groupBy("kind", "entity").agg(titled("f").alias("f"), titled("m").alias("m"))
    entities = shared(entities.select("kind", "entity", gender_of(F.col("entity"), F.col("f"), F.col("m")).alias("gender")))
    table = surrogates(entities, key)
    heard = parts.join(table, ["kind", "entity"]).groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "word", "surrogate"))).alias("parts"))
    last = F.element_at("parts", -1)
    family = F.when(last["kind"] == "family", last)
    said = written(kind, F.col("mention"), F.col("parts"))
    return heard.select("mention", said.alias("said"), family["word"].alias("word"), _cased(family["word"], family["surrogate"]).alias("new"))


def pseudonymize(documents: DataFrame, key: str, counts: str | None = None) -> DataFrame:
    """documents with entities in the column text replaced; `counts`: a column for the number of mentions."""
    text = F.coalesce("row.text", F.lit(""))
    held = [F.col(f"row.`{c}`") for c in documents.columns if c in ("doc_id", "text")]
    # rows without a text meet nobody, and not all in one place
    row_key = F.when(text == "", F.monotonically_increasing_id()).otherwise(F.xxhash64(*held))
    rows = documents.select(F.struct("*").alias("row")).select("row", row_key.alias("key"), text.alias("t"))
    mentions = shared(rows.filter("t <> ''").select("key", F.explode(F.array_distinct(mentions_of(F.col("t")))).alias("mention")).distinct())
    known = mentions.groupBy("mention").agg(F.count("*").alias("n"))
    table = shared(replacements(known.select("mention"), key).join(known, "mention"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    many = F.col("n") * MANY >= total
    answer = F.struct("mention", "said", "word", "new").alias("answer")
    found = mentions.join(F.broadcast(table.filter(many).select("mention", answer)), "mention", "left")
    rest = found.filter("answer is null").select("key", "mention").join(table.filter(~many).select("mention", answer), "mention")
    found = found.filter("answer is not null").select("key", "answer").unionAll(rest.select("key", "answer"))
    pair = F.struct(F.col("answer.mention").alias("old"), F.col("answer.said").alias("new"))
    name = F.when(F.col("answer.word").isNotNull(), F.struct(F.col("answer.word").alias("old"), F.col("answer.new").alias("new")))
    said = found.groupBy("key").agg(F.map_from_entries(F.collect_list(pair)).alias("said"), F.array_sort(F.collect_set(name)).alias("names"))
    joined = rows.join(said, "key", "left").select("row", "t", "said", "names", F.when(F.col("said").isNotNull(), mentions_of(F.col("t"))).alias("found"), F.when(F.col("said").isNotNull(), F.split("t", EVERY, -1)).alias("gaps"))

    def alone(gap: Column) -> Column:
        """The text between mentions, with the family names of the document replaced."""
        word = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{M}])"), x["old"], F.lit(r"(?![\p{L}\p{M}])"))
        return F.aggregate(F.col("names"), gap, lambda g, x: F.regexp_replace(g, word(x), x["new"]))

    new = F.array_join(F.zip_with(F.transform("gaps", alone), "found", lambda g, m: F.concat(g, F.coalesce(F.element_at(F.col("said"), m), F.lit("")))), "")
    value = F.when(F.col("found").isNotNull() & (F.size("found") > 0), new).otherwise(F.col("row.text"))
    columns = [value.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns if c != counts]
    if counts:
        columns.append(F.coalesce(F.size("found"), F.lit(0)).cast("long").alias(counts))
    return joined.select(*columns)
