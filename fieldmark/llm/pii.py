"""PII surrogates, in DataFrame functions only.

Mentions are found by one pattern and taken apart: a name into given names and surname, a number into its digits without
separators, an address into lower case. Each distinct part gets one surrogate for the whole corpus, by a keyed hash, so
"Dr. Anna Keller", "ANNA KELLER", "Mrs Keller" and a later bare "Keller" stay one person, and a phone number written in
two ways stays one number: all its digits name it, and one without a country code is read as of country 1, whose two
forms are the only ones found so. Surrogates keep the type and its format: separators, lengths and letter case, country prefixes,
valid check digits of cards and IBANs, octets in range for addresses, the domain of an e-mail address mapped by itself;
names keep their title and take a given name of the same gender and an invented surname, both of the same script (Latin,
Cyrillic or Greek). A surrogate that two parts of a kind would share, or that is a part found in the corpus, is drawn
anew; from the eighth draw on draws grow by one character each, so drawing ends with all distinct and none real.

Names are found after a title, after a phrase that gives a name, with a common given name in front, and, once a document
has named somebody so, by the surname alone if it has two letters at least. Other names, and those in scripts without capitals, are not found.

Scale: one pass finds mentions, and only texts that have any are stored; another takes the other texts over. Parts are
combined to a distinct table by shuffle; surrogates are joined back to texts by mention (Spark splits hot ones), gathered
by text, and applied. Nothing is broadcast or collected.

Edge cases: null text stays null, empty stays empty; texts without mentions are unchanged, byte for byte; repeated rows
are rewritten alike; rows may share ids; long texts are rewritten whole; an empty table gives an empty result. Columns
are taken by name; others do not matter, nor do their names.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm._base import free_shuffles, store, table

#: The setting that holds the secret. Without it the default below is used, which is public: surrogates can then be
#: traced back by trying.
KEY_SETTING = "spark.fieldmark.pii.key"
DEFAULT_KEY = "fieldmark"

# Fixed values.
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|Lady"
MALE_TITLES = "Mr|Herr|Señor|Sr|Monsieur|Sir|Lord"
NEUTRAL_TITLES = "Dr|Prof|Professor|Doctor"
FEMALE_NAMES = ("Alice", "Anna", "Clara", "Elena", "Emma", "Eva", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nina", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Susan", "Vera")
MALE_NAMES = ("Adam", "Albert", "Bruno", "Carlos", "Daniel", "David", "Felix", "Henry", "Hugo", "Ivan", "Jacob", "James", "John", "Leo", "Louis", "Martin", "Oscar", "Paul", "Peter", "Victor")
#: Given names that are found, not given.
MORE_FEMALE = ("Aisha", "Amina", "Camille", "Carmen", "Charlotte", "Elizabeth", "Emily", "Fatima", "Hannah", "Ingrid", "Isabel", "Jane", "Jennifer", "Jessica", "Katherine", "Leila", "Linda", "Mary", "Michelle", "Monika", "Patricia", "Priya", "Rachel", "Sarah", "Sophie", "Ursula", "Yuki")
MORE_MALE = ("Ahmed", "Andreas", "Antonio", "Benjamin", "Charles", "Christopher", "Diego", "Edward", "Fernando", "François", "George", "Hans", "Hassan", "Hiroshi", "Ibrahim", "Javier", "José", "Joseph", "Juan", "Jürgen", "Klaus", "Kenji", "Luis", "Marco", "Michael", "Mohammed", "Omar", "Pierre", "Rahul", "Richard", "Robert", "Stefan", "Thomas", "Wei", "William", "Wolfgang")
CYRILLIC_FEMALE = ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья")
CYRILLIC_MALE = ("Алексей", "Борис", "Виктор", "Иван", "Николай", "Олег", "Пётр", "Сергей")
GREEK_FEMALE = ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία")
GREEK_MALE = ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος", "Πέτρος")
LATIN_SYLLABLES = ("bar", "cor", "dan", "fel", "gar", "hol", "kel", "lan", "mar", "nor", "pel", "ros", "sal", "tor", "val", "wen")
CYRILLIC_SYLLABLES = ("бар", "вол", "гор", "дан", "кор", "лан", "мар", "нов", "пол", "рос", "сан", "тор")
GREEK_SYLLABLES = ("βαρ", "γορ", "δαν", "καλ", "λαν", "μαρ", "νικ", "παλ", "ρος", "σαν", "τορ", "φελ")
CUES = ("my name is ", "My name is ", "Mein Name ist ", "mein Name ist ", "ich heiße ", "Ich heiße ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "mi nombre es ", "меня зовут ", "Меня зовут ", "με λένε ", "Με λένε ")

_FEMALE = (*FEMALE_NAMES, *MORE_FEMALE, *CYRILLIC_FEMALE, *GREEK_FEMALE)
_MALE = (*MALE_NAMES, *MORE_MALE, *CYRILLIC_MALE, *GREEK_MALE)
_FIRST = "|".join(x for n in (*_FEMALE, *_MALE) for x in (n, n.upper()))
_TITLE = f"(?:{FEMALE_TITLES}|{MALE_TITLES}|{NEUTRAL_TITLES})\\.? "
_CAPITAL = "\\p{Lu}[\\p{L}'’]*(?:-\\p{Lu}[\\p{L}'’]*)*"
#: Types in the order in which they are tried.
PATTERNS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "(?=[0-9])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])",
    "iban": "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "secret": "(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}|(?:[0-9]+[a-f]|[a-f]+[0-9])[0-9a-f]{30,}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": "[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}",
    "phone": "\\+[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?(?:[ .-]?[0-9]{2,4}){1,3}|\\+[0-9]{8,14}|\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
    "name": f"(?=\\p{{Lu}})(?:{_TITLE}{_CAPITAL}(?: {_CAPITAL}){{0,2}}|(?:{_FIRST})(?: {_CAPITAL}){{1,2}}|(?<={'|'.join(CUES)}){_CAPITAL}(?: {_CAPITAL}){{1,2}})",
}
_LEFT, _RIGHT = "(?<![\\p{L}\\p{N}@.+-])", "(?![\\p{L}\\p{N}@])"
PATTERN = _LEFT + "(?:" + "|".join(PATTERNS.values()) + ")" + _RIGHT
#: Kinds whose parts are their letters and digits, laid into the places of the mention.
_SPACED = ("iban", "card", "ssn", "phone")
#: Country codes by the numbering plan: one digit, two, else three.
_COUNTRY = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Draws before draws grow.
PLAIN_DRAWS = 8


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def entity_type(entity: Column) -> Column:
    """The first type whose pattern is the whole mention; a name may be any."""
    out = None
    for name, pattern in PATTERNS.items():
        if name != "name":
            test = entity.rlike(f"^(?:{pattern})$")
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("name")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _draw(seed: Column, i: Column, of: int) -> Column:
    """A number below `of`, by seed and place."""
    return F.pmod(F.xxhash64(seed, i), F.lit(of)).cast("int")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n + 1)


def _scramble(text: Column, seed: Column, *, hexadecimal: bool = False) -> Column:
    """Digits for digits and letters for letters of the same case, place by place; all else stays."""
    letters = 6 if hexadecimal else 26

    def place(c: Column, i: Column) -> Column:
        n = _draw(seed, i, letters)
        return (
            F.when(c.between("0", "9"), F.substring(F.lit("0123456789"), _draw(seed, i, 10) + 1, F.lit(1)))
            .when(c.between("a", "z"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), place), "")


def _more(attempt: Column) -> Column:
    """How many characters a draw adds."""
    return F.greatest(attempt - (PLAIN_DRAWS - 1), F.lit(0))


def _ip(key: Column, seed: Column, attempt: Column) -> Column:
    """Octets with as many digits as before; any octets from the fifth draw on."""

    def octet(o: Column, i: Column) -> Column:
        n = F.length(o)
        own = F.when(n == 1, _draw(seed, i, 10)).when(n == 2, _draw(seed, i, 90) + 10).otherwise(_draw(seed, i, 156) + 100)
        return F.when(attempt < 4, own).otherwise(_draw(seed, i, 256)).cast("string")

    return F.array_join(F.transform(F.split(key, "\\."), octet), ".")


def _card(key: Column, seed: Column) -> Column:
    """The first digit stays, the last makes the Luhn sum a multiple of ten."""
    mixed = F.concat(F.substring(key, 1, 1), _scramble(F.substring(key, 2, 40), seed))
    head = F.substring(mixed, F.lit(1), F.length(mixed) - 1)
    double = lambda n: F.when(n * 2 > 9, n * 2 - 9).otherwise(n * 2)
    total = F.aggregate(F.transform(_chars(F.reverse(head)), lambda c, i: F.when(i % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.concat(head, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def mod97(compact: Column) -> Column:
    """The remainder by 97 of letters and digits read as a number, letters as 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        n = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(n > 9, (r * 100 + n) % 97).otherwise((r * 10 + n) % 97)

    return F.aggregate(_chars(compact), F.lit(0), step)


def _iban(key: Column, seed: Column) -> Column:
    """The country stays; the check digits are those of the scrambled account."""
    account = _scramble(F.substring(key, 5, 60), seed)
    check = F.lit(98) - mod97(F.concat(account, F.substring(key, 1, 2), F.lit("00")))
    return F.concat(F.substring(key, 1, 2), F.lpad(check.cast("string"), 2, "0"), account)


def _phone(key: Column, seed: Column) -> Column:
    """The country code stays; digits for the other digits, the first of which is not 0 unless it was."""
    code = F.regexp_extract(key, f"^{_COUNTRY}", 0)
    own = F.substring(key, F.length(code) + 1, F.length(key))
    digits = _scramble(own, seed)
    first = F.when(F.substring(own, 1, 1) == "0", "0").otherwise((_draw(seed, F.lit(-1), 9) + 1).cast("string"))
    return F.concat(code, first, F.substring(digits, F.lit(2), F.length(digits)))


def _email(key: Column, seed: Column, secret: Column, attempt: Column) -> Column:
    """The local part by the address, the domain by itself, its last label as it is."""
    local, domain = F.substring_index(key, "@", 1), F.substring_index(key, "@", -1)
    head = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)))
    own = _scramble(head, F.sha2(F.concat(secret, F.lit("domain:"), domain), 256))
    # Short local parts grow early, for there may be more of them than letters allow.
    more = F.when(attempt > 1, _scramble(F.repeat(F.lit("x"), attempt), F.concat(seed, F.lit("+")))).otherwise("")
    return F.concat(_scramble(local, seed), more, F.lit("@"), own, F.substring_index(domain, ".", -1))


def _script(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic").when(word.rlike("\\p{IsGreek}"), "greek").otherwise("latin")


_SYLLABLES = {"latin": LATIN_SYLLABLES, "cyrillic": CYRILLIC_SYLLABLES, "greek": GREEK_SYLLABLES}
#: The endings of invented given names, female and male.
_ENDINGS = {"latin": ("a", "o"), "cyrillic": ("а", "ин"), "greek": ("α", "ος")}
_GIVEN = {"latin": (FEMALE_NAMES, MALE_NAMES), "cyrillic": (CYRILLIC_FEMALE, CYRILLIC_MALE), "greek": (GREEK_FEMALE, GREEK_MALE)}


def _by_script(script: Column, make: Any) -> Column:
    return F.when(script == "cyrillic", make("cyrillic")).when(script == "greek", make("greek")).otherwise(make("latin"))


def _syllables(script: str, seed: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(_SYLLABLES[script], _draw(seed, i, len(_SYLLABLES[script])))), "")


def _family(key: Column, seed: Column, attempt: Column) -> Column:
    return _by_script(_script(key), lambda s: _syllables(s, seed, F.lit(3) + _more(attempt + 4)))


def _given(key: Column, female: Column, seed: Column, attempt: Column) -> Column:
    """A name of the pool in the first draws, then an invented one."""

    def make(s: str) -> Column:
        pool = F.when(female, _pick(tuple(n.lower() for n in _GIVEN[s][0]), _draw(seed, F.lit(-1), len(_GIVEN[s][0])))).otherwise(_pick(tuple(n.lower() for n in _GIVEN[s][1]), _draw(seed, F.lit(-1), len(_GIVEN[s][1]))))
        own = F.concat(_syllables(s, seed, F.lit(2) + _more(attempt)), F.when(female, _ENDINGS[s][0]).otherwise(_ENDINGS[s][1]))
        return F.when(attempt < 3, pool).otherwise(own)

    return _by_script(_script(key), make)


def surrogate(slot: Column, key: Column, attempt: Column, secret: str) -> Column:
    """Draw number `attempt` for a part; slots are kinds, or family, given-f and given-m for the parts of names."""
    own = F.lit(secret)
    seed = F.sha2(F.concat(own, F.lit(":"), slot, F.lit(":"), attempt.cast("string"), F.lit(":"), key), 256)
    longer = F.concat(key, F.repeat(F.lit("0"), _more(attempt)))
    hexadecimal = key.rlike("^[0-9a-f]+$")
    return (
        F.when(slot == "email", _email(key, seed, own, attempt))
        .when(slot == "ip", F.concat(_ip(key, seed, attempt), F.repeat(F.lit("0"), _more(attempt))))
        .when(slot == "card", _card(longer, seed))
        .when(slot == "phone", _phone(longer, seed))
        .when(slot == "family", _family(key, seed, attempt))
        .when(slot.startswith("given"), _given(key, slot == "given-f", seed, attempt))
        .when(slot == "iban", _iban(longer, seed))
        .when((slot == "secret") & hexadecimal, _scramble(longer, seed, hexadecimal=True))
        .when(slot == "secret", F.concat(F.substring(longer, 1, 4), _scramble(F.substring(longer, F.lit(5), F.length(longer)), seed)))
        .otherwise(_scramble(longer, seed))
    )


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, f"^{_TITLE}", 0)


def _named(entity: Column) -> Column:
    """A name without its title."""
    return F.substring(entity, F.length(_title(entity)) + 1, F.length(entity))


def surname(entity: Column) -> Column:
    return F.substring_index(_named(entity), " ", -1)


def _pieces(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("[^ -]+"), F.lit(0))


def parts_of(known: DataFrame) -> DataFrame:
    """(entity, kind) -> (entity, place, slot, key): the parts of each mention, in normal form, by place."""
    e, kind = F.col("entity"), F.col("kind")
    part = lambda slot, key, female: F.struct(F.lit(slot).alias("slot") if isinstance(slot, str) else slot.alias("slot"), key.alias("key"), female.alias("female"))
    none = F.lit(None).cast("boolean")
    compact = F.regexp_replace(F.upper(e), "[^0-9A-Z]", "")
    # All digits name a number, its country's before them; forms without a country are those of country 1.
    digits = F.concat(F.when(e.startswith("+"), "").otherwise("1"), F.regexp_replace(e, "[^0-9]", ""))
    key = F.when(kind == "email", F.lower(e)).when(kind.isin("iban", "card", "ssn"), compact).when(kind == "phone", digits).otherwise(e)
    title, pieces = _title(e), _pieces(_named(e))
    last = F.size(pieces) - F.size(_pieces(surname(e)))
    told = F.when(title.rlike(f"^(?:{FEMALE_TITLES})\\b"), True).when(title.rlike(f"^(?:{MALE_TITLES})\\b"), False)
    known_as = lambda w: F.when(w.isin(*{n.lower() for n in _FEMALE}), True).when(w.isin(*{n.lower() for n in _MALE}), False)
    of_name = F.transform(pieces, lambda w, i: part(F.when(i < last, "given").otherwise("family"), F.lower(w), F.when(i < last, F.coalesce(told, known_as(F.lower(w))))))
    flat = known.select("entity", F.posexplode(F.when(kind == "name", of_name).otherwise(F.array(part(kind, key, none)))).alias("place", "p")).select("entity", "place", "p.*")
    # A given name without a title goes by what the corpus says of it elsewhere, then by its last letter.
    votes = flat.where(F.col("female").isNotNull()).groupBy("slot", "key").agg((F.count_if("female") >= F.count_if(~F.col("female"))).alias("vote"))
    told = flat.join(votes.hint("merge"), ["slot", "key"], "left")
    female = F.coalesce("female", "vote", F.col("key").rlike("[aeαаяη]$"))
    return told.select("entity", "place", F.when(F.col("slot") != "given", F.col("slot")).when(female, "given-f").otherwise("given-m").alias("slot"), "key")


def draw_all(parts: DataFrame, secret: str) -> DataFrame:
    """(slot, key) -> (slot, key, surrogate): distinct within each slot, and none is a key of its slot."""
    known = store(parts.select("slot", "key").distinct(), "pii-parts")
    drawn = store(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("slot"), F.col("key"), F.lit(0), secret)), "pii-draws")
    real = known.select("slot", F.col("key").alias("surrogate"), (~F.col("slot").startswith("given")).alias("real"))
    while True:
        # Of those that share a surrogate the earliest draw and least key keeps it; a real surname or number gives way to
        # none, while given names are common to many.
        keeper = drawn.groupBy("slot", "surrogate").agg(F.min(F.struct("attempt", "key")).alias("k"), F.count(F.lit(1)).alias("n"))
        shared = keeper.where("n > 1").select("slot", "surrogate", F.col("k.key").alias("keeper"))
        again = drawn.join(shared.hint("merge"), ["slot", "surrogate"], "left").join(real.hint("merge"), ["slot", "surrogate"], "left")
        lost = F.coalesce("real", F.lit(False)) | (F.col("keeper") != F.col("key")) | (F.col("slot").startswith("given") & (F.col("surrogate") == F.col("key")))
        again = store(again.where(F.coalesce(lost, F.lit(False))).select("slot", "key", (F.col("attempt") + 1).alias("attempt")), "pii-again")
        if not again.limit(1).count():
            return drawn.select("slot", "key", "surrogate")
        fresh = again.withColumn("surrogate", surrogate(F.col("slot"), F.col("key"), F.col("attempt"), secret))
        drawn = store(drawn.join(again.select("slot", "key").hint("merge"), ["slot", "key"], "left_anti").unionByName(fresh), "pii-draws")


def _lay(entity: Column, key: Column, value: Column) -> Column:
    """value in the places of the mention's letters and digits that are its key, its last ones; what a draw has grown by
    goes into the last place."""
    bare = lambda s: F.length(F.regexp_replace(s, "[^0-9A-Za-z]", ""))
    spare = F.length(value) - F.length(key)
    kept = bare(entity) - F.length(key)

    def place(c: Column, i: Column) -> Column:
        nth = bare(F.substring(entity, F.lit(1), i + 1))
        here = F.substring(value, nth - kept, F.when(nth == bare(entity), spare + 1).otherwise(1))
        return F.when(~c.rlike("[0-9A-Za-z]") | (nth <= kept), c).otherwise(here)

    return F.array_join(F.transform(_chars(entity), place), "")


def _recase(value: Column, like: Column) -> Column:
    """value in the case of a mention: all capitals, or capitals in the places of its."""
    capitals = F.transform(_chars(value), lambda c, i: F.when(F.substring(like, i + 1, F.lit(1)).rlike("\\p{Lu}"), F.upper(c)).otherwise(c))
    return F.when((F.length(like) > 1) & (like == F.upper(like)) & (like != F.lower(like)), F.upper(value)).otherwise(F.array_join(capitals, ""))


def _worded(entity: Column, values: Column) -> Column:
    """A name with its words replaced in order."""
    old, seps = _pieces(_named(entity)), F.concat(F.regexp_extract_all(_named(entity), F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    one = lambda v, w: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(v)).otherwise(F.initcap(v))
    return F.concat(_title(entity), F.array_join(F.zip_with(F.zip_with(values, old, one), seps, lambda v, s: F.concat(v, s)), ""))


def surrogates(found: DataFrame, secret: str) -> DataFrame:
    """(entity) -> (entity, kind, surrogate)."""
    known = store(found.select("entity").distinct().withColumn("kind", entity_type(F.col("entity"))), "pii-entities")
    parts = store(parts_of(known), "pii-places")
    drawn = parts.join(draw_all(parts, secret).hint("merge"), ["slot", "key"])
    values = drawn.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "surrogate"))), lambda p: p["surrogate"]).alias("v"), F.min_by("key", "place").alias("key"))
    e, first = F.col("entity"), F.element_at("v", 1)
    mail = F.concat(_recase(F.substring_index(first, "@", 1), F.substring_index(e, "@", 1)), F.lit("@"), _recase(F.substring_index(first, "@", -1), F.substring_index(e, "@", -1)))
    made = F.when(F.col("kind") == "email", mail).when(F.col("kind") == "name", _worded(e, F.col("v"))).when(F.col("kind").isin(*_SPACED), _lay(e, F.col("key"), first)).otherwise(first)
    return store(known.join(values.hint("merge"), "entity").select("entity", "kind", made.alias("surrogate")), "pii-surrogates")


def replace_entities(docs: DataFrame, *, text: str = "text", key: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, the rewritten text, n_entities (mentions) and kinds (types found, in order of name)."""
    spark = docs.sparkSession
    secret = key or spark.conf.get(KEY_SETTING, None) or DEFAULT_KEY
    body = F.col(text)
    # Generated, so that the pattern runs once for the filter and the column.
    hits = docs.where(body.isNotNull()).select(*carry, body.alias("_text"), F.explode(F.array(entities(body))).alias("_first")).where(F.size("_first") > 0)
    hits = store(hits.withColumn("_row", F.xxhash64("_text")).withColumn("_crc", F.crc32(F.col("_text").cast("binary"))), "pii-hits")
    # Where somebody has been named, the surname alone is a mention too.
    names = F.array_distinct(F.transform(F.filter("_first", lambda e: entity_type(e) == "name"), surname))
    names = F.filter(names, lambda s: F.length(s) > 1)
    alone = F.when(F.size("_s") > 0, F.concat(F.lit(f"{PATTERN}|{_LEFT}(?:"), F.array_join("_s", "|"), F.lit(f"){_RIGHT}"))).otherwise(PATTERN)
    hits = hits.withColumn("_s", names).withColumn("_pattern", alone).withColumn("_e", F.when(F.size("_s") > 0, F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))).otherwise(F.col("_first")))
    each = hits.select("_row", "_crc", F.explode(F.array_distinct("_e")).alias("entity")).distinct()
    each = store(each, "pii-mentions")
    drawn = surrogates(each, secret)
    maps = each.join(drawn.hint("merge"), "entity").groupBy("_row", "_crc").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    own = hits.join(maps.hint("merge"), ["_row", "_crc"]).withColumn("_gaps", F.split("_text", F.col("_pattern")))
    new = F.concat(F.element_at("_gaps", 1), F.array_join(F.zip_with(F.col("_e"), F.slice("_gaps", F.lit(2), F.size("_gaps")), lambda e, gap: F.concat(F.element_at("_map", e), gap)), ""))
    changed = own.select(*carry, new.alias(text), F.size("_e").cast("long").alias("n_entities"), "kinds")
    free_shuffles(spark)
    has = F.coalesce(body.rlike(PATTERN), F.lit(False))
    same = docs.where(~has).select(*carry, body.alias(text), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return same.unionByName(changed)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
