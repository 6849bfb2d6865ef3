"""Surrogates for personal data: keyed, type-consistent replacements; DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, US social-security numbers, IBANs, card numbers (13 to 19 digits), phone
numbers, secrets (long hexadecimal strings, well-known key prefixes, values after words like token or password) and names
(of scripts that have capitals) after a courtesy or academic title, or of two words or more after a label such as "Name:".
Everything else stays as it is, character by character.

A surrogate is a function of the key, the type and the entity's normal form, so the same entity has the same surrogate
in all documents (coreference), and without the key the original can't be found.  It keeps the format: digits stay
digits, letters stay letters of their script and case, punctuation stays; a card number that passes the Luhn check has a
surrogate that passes it; mail goes to a reserved domain; a name keeps its title, has a given name of the title's gender
(of either after titles that tell none) and a surname in its script.  A surname's surrogate follows from the surname alone, so
"Smith" and "John Smith" keep what they have in common whatever collides.

Distinctness is checked over all entities of all documents: where two have one surrogate, or a surrogate is another's
original, all but the first get another attempt.  Later attempts draw from larger spaces: mail names get a letter more with each, given
names another given name, surnames a syllable with every second, everything else a digit more with each from WIDEN on.  So the share
that collides falls at least tenfold a round from then on, and rounds grow with the logarithm of the entities;
MOST_ROUNDS is never met but by an error.  Only entities with more than one attempt are joined back, so usually nothing is
shuffled but the distinct entities.

Defined results: null text stays null; empty text stays empty; a text without entities is unchanged; repeated rows get the
same text; ties (two entities with one surrogate) go to the first normal form in order; an empty table gives an empty table;
other columns are kept by ``replace`` as they are, but for one with the name of the column that it adds, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stash

KEY = "tarnwell-surrogates"
#: Attempt from which formats get longer, and rounds after which something must be wrong.
WIDEN, MOST_ROUNDS = 4, 100
#: Rows of a table of entities that are broadcast.
FEW = 500_000
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Courtesy titles, by gender of the name that follows.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña", "Госпожа", "г-жа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Don", "Господин", "г-н", "Κύριος"),
    "n": ("Dr", "Prof", "Professor", "Docteur", "Доктор", "Профессор", "Δρ"),
}
# Labels that a name follows.
LABELS = ("Name", "Full name", "Contact person", "Signed by", "Nombre", "Nom", "Имя", "Ονομα")
# Given names, by gender and script.
GIVEN = {
    ("f", "latin"): ("Ada", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Ines", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"),
    ("m", "latin"): ("Anton", "Bruno", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Karl", "Leo", "Martin", "Oskar", "Paul", "Viktor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("f", "greek"): ("Άννα", "Δήμητρα", "Ειρήνη", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"),
    ("m", "greek"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"),
}
# Syllables of surnames.
SYLLABLES = {
    "latin": ("ba", "del", "fen", "gor", "hal", "kam", "lin", "mor", "nev", "pel", "ros", "sol", "tam", "ver", "wal", "zan"),
    "greek": ("βα", "γορ", "δελ", "ζαν", "θεο", "καμ", "λιν", "μορ", "νεβ", "πελ", "ροδ", "σολ", "ταμ", "φιλ", "χαρ", "ψαλ"),
    "cyrillic": ("ба", "вел", "гор", "дан", "жук", "зал", "кам", "лин", "мор", "нев", "пол", "рос", "сол", "там", "фер", "яр"),
}
# Letters that stand for others of a script without capitals.
LETTERS = {
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsDevanagari}": "अकखगघचजझटडतदधनपफबभमयरलवशसह",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの", r"\p{IsKatakana}ー": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조호", r"\p{IsHan}": "安白成方高海江金林明平青山石田文新永玉元中正",
}
_TITLE = "|".join(sorted((t for k in TITLES for t in TITLES[k]), key=len, reverse=True))
_LABEL = "|".join(LABELS)
# possessive, as a greedy repeat of a group takes the stack of the regex engine for each time
_NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{L}+)*+"

#: One pattern for each type, in order of precedence. A domain has at most 127 labels, a limit of the format.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?){0,125}\.\p{L}{2,}",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,})(?!\w)"
    r"|(?<=\b(?i:token|secret|password|passwd|api_key|apikey)[^\w\s\"']{0,3}\s?[=:][^\w\s\"']{0,3}\s?[\"'])[^\"'\s]{6,}(?=[\"'])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[^\w\s]{0,3}[ .-]?\(?\d{2,4}\)?[^\w\s]{0,3}(?:[ .-]?\d{2,5}){1,4}(?!\w)|(?<![\w(+.-])\(?\d{3}\)?[^\w\s]{0,3}[ .-]\d{3}[.-]\d{4}(?![\w-])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}|(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{_LABEL})\s?:\s?){_NAME}(?: {_NAME}){{1,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: a cheap test before the patterns. Secrets need no digit, so their prefixes and keywords count.
HINT = rf"[0-9@]|(?:{_TITLE})\.? \p{{Lu}}|(?:{_LABEL})\s?:\s?\p{{Lu}}|AKIA|gh[pousr]_|sk-|xox[abprs]-|(?i:token|secret|password|passwd|api_key|apikey)[^\w\s\"']{{0,3}}\s?[=:]"
TYPES = tuple(PATTERNS)
#: Characters that one stream is enough for.
PIECE = 60


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: expressions that use it many times stay small."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def kind(e: Column) -> Column:
    """Type of a detected string."""
    digits = F.length(F.regexp_replace(e, r"\D", ""))
    return (
        F.when(e.contains("@") & e.rlike(f"^(?:{PATTERNS['email']})$"), "email").when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(rf"^(?:{_TITLE})\.? |^{_NAME}(?: {_NAME}){{1,2}}$"), "person").when(e.rlike(f"^(?:{PATTERNS['iban']})$"), "iban").when(e.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .when(e.rlike(r"^[+(\d][^\p{L}]*$") & digits.between(7, 20), "phone").otherwise("secret")
    )


def normal(e: Column, k: Column) -> Column:
    """Normal form: what two mentions of one entity have in common."""
    return (
        F.when(k == "email", F.lower(e)).when(k.isin("card", "phone", "ssn"), F.regexp_replace(e, r"\D", "")).when(k == "iban", F.regexp_replace(e, " ", ""))
        .when(k == "person", F.lower(F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", ""))).otherwise(e)
    )


def _stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that follow from the key and the parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f+")), 256))


def _byte(stream: Column, i: Column) -> Column:
    """Number i of the stream, 0 to 65535 (i wraps after 62)."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(62)) * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _shaped(e: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Each digit and letter replaced by one of its kind; the rest stays and uses nothing of the stream."""
    low, up = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def drawn(c: Column, n: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick(low, n)).when(c.rlike("[A-Z]"), _pick(up, n))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", n)).otherwise(_pick("абвгдежзиклмнопрстуфхцчшэюя", n)))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), _pick("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", n)).otherwise(_pick("αβγδεζηθικλμνξοπρστυφχψω", n)))
            .when(~c.rlike(r"[\p{L}]"), c).when(c.rlike("[" + "".join(LETTERS) + "]"), F.coalesce(*(F.when(c.rlike(f"[{k}]"), _pick(v, n)) for k, v in LETTERS.items())))
            .when(c.rlike(r"\p{Lu}"), _pick("ÀÂÄÉÈÊËÎÏÔÖÙÜÑÇ", n)).when(c.rlike(r"\p{L}"), _pick("àâäéèêëîïôöùüñç", n)).otherwise(c)
        )

    def shape(piece: Column, own: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substring(piece, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
            return let(_byte(own, nth), lambda n: drawn(c, n))

        return F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(r"(?s)(.)"), F.lit(1)), one), "")

    # each piece has a stream of its own, so that the time follows the length and nothing repeats
    pieces = F.regexp_extract_all(e, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda piece, p: let(F.when(p == 0, stream).otherwise(_stream("", stream, p.cast("string"))), lambda own: shape(piece, own))), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, its last digit counted once."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def _card(e: Column, stream: Column, digits: Column) -> Column:
    """First digit kept, the others replaced; the last one so that the Luhn check comes out as that of the digits."""

    def valid(drawn: Column) -> Column:
        plain = F.regexp_replace(drawn, r"\D", "")
        last = let(F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit("0")), lambda body: F.pmod(-_luhn(body), F.lit(10)).cast("string"))
        return F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), last)

    passes = let(digits, _luhn) % 10 == 0
    return let(F.concat(F.substring(e, 1, 1), _shaped(F.substring(e, F.lit(2), F.length(e) - 1), stream)), lambda drawn: F.when(passes, valid(drawn)).otherwise(drawn))


def _names(e: Column) -> Column:
    """A person's names without the title."""
    return F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", "")


def _surname(names: Column) -> Column:
    return F.element_at(F.split(names, " "), -1)


def _by_script(names: Column, of) -> Column:
    return F.when(names.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(names.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surname_surrogate(surname: Column, attempt: Column, key: str) -> Column:
    """Syllables in the surname's script: four, and one more with every second attempt."""

    def drawn(s: Column) -> Column:
        def of(script: str) -> Column:
            syllables = F.array(*map(F.lit, SYLLABLES[script]))
            several = F.transform(F.sequence(F.lit(0), (3 + F.floor(attempt / 2)).cast("int")), lambda i: F.element_at(syllables, F.pmod(_byte(s, i * 2), F.lit(16)) + 1))
            return F.array_join(several, "")

        return let(_by_script(surname, of), lambda x: F.when((F.length(surname) > 1) & (surname == F.upper(surname)), F.upper(x)).otherwise(F.initcap(x)))

    return let(_stream(key, F.lit("surname"), F.lower(surname), attempt.cast("string")), drawn)


def given_surrogate(e: Column, attempt: Column, key: str) -> Column:
    """Given names of the title's gender: one, and one more with every attempt."""
    names = _names(e)
    female, male = (e.rlike("^(?:" + "|".join(TITLES[x]) + r")\.? ") for x in ("f", "m"))

    def drawn(g: Column) -> Column:
        woman = female | (~male & (F.pmod(_byte(g, F.lit(60)), F.lit(2)) == 0))

        def of(script: str) -> Column:
            lists = [F.array(*map(F.lit, GIVEN[x, script])) for x in ("f", "m")]
            one = lambda given, i: F.element_at(given, F.pmod(_byte(g, i * 2), F.size(given)) + 1)
            return F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(woman, one(lists[0], i)).otherwise(one(lists[1], i))), "-")

        return let(_by_script(names, of), lambda x: F.when(names == F.upper(names), F.upper(x)).otherwise(x))

    return let(_stream(key, F.lit("given"), F.lower(names), attempt.cast("string")), drawn)


def _person(e: Column, key: str, attempt: Column, given: Column) -> Column:
    """attempt: of the surname; given: of the given name."""
    names = _names(e)
    title = F.substring(e, F.lit(1), F.length(e) - F.length(names))
    last = surname_surrogate(_surname(names), attempt, key)
    return F.concat(title, F.when(names.contains(" "), F.concat(given_surrogate(e, given, key), F.lit(" "), last)).otherwise(last))


def _replaced(e: Column, k: Column, s: Column, attempt: Column, key: str, given: Column) -> Column:
    more = F.greatest(attempt - (WIDEN - 1), F.lit(0))
    octets = F.concat_ws(".", *(F.pmod(_byte(s, F.lit(2 * i)), F.lit(254)) + 1 for i in range(4)))
    port = F.when(more > 0, F.concat(F.lit(":"), _shaped(F.repeat(F.lit("0"), more), F.reverse(s)))).otherwise("")
    local, domain = F.concat(F.split(e, "@")[0], F.repeat(F.when(e == F.upper(e), F.lit("A")).otherwise(F.lit("a")), attempt)), F.split(e, "@")[1]
    sub = F.regexp_extract(domain, r"^(.*\.)?[^.]+\.[^.]+$", 1)
    end = F.concat(F.lit("example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), F.pmod(_byte(s, F.lit(61)), F.lit(3)) + 1))
    mail = F.concat(_shaped(local, s), F.lit("@"), _shaped(sub, F.reverse(s)), F.when(domain == F.upper(domain), F.upper(end)).otherwise(end))
    wide = F.concat(e, F.repeat(F.lit("0"), more))
    prefix = F.when(k == "phone", F.regexp_extract(e, r"^\+\d{1,3}(?=\D)", 0)).when(k == "iban", F.substring(e, 1, 2)).otherwise("")
    shaped = let(prefix, lambda head: F.concat(head, _shaped(F.substring(wide, F.length(head) + 1, F.length(wide)), s)))
    return (
        F.when(k == "email", mail).when(k == "ip", F.concat(octets, port)).when(k == "card", _card(wide, s, F.regexp_replace(e, r"\D", ""))).when(k == "person", _person(e, key, attempt, given))
        .when(k.isin("phone", "ssn", "iban"), shaped).when(e.rlike("^[0-9a-fA-F]+$"), _shaped(wide, s, True)).otherwise(shaped)
    )


def surrogate(e: Column, attempt: Column, key: str = KEY, given: Column | None = None) -> Column:
    """Replacement of a detected string; of a person, attempt is the surname's and given that of the given name."""
    given = F.lit(0) if given is None else given
    return let(kind(e), lambda k: let(_stream(key, k, normal(e, k), attempt.cast("string")), lambda s: _replaced(e, k, s, attempt, key, given)))


def entities(text: Column) -> Column:
    """Detected strings in order; empty without any, null for a null text."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def attempts(documents: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame | None:
    """e, attempt, given of the detected strings that don't keep their first surrogate, or None if all do."""
    found = documents.select(F.explode(entities(F.col(text_col))).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    mentions = stash(found.select("e", kind(F.col("e")).alias("kind")).withColumn("norm", normal(F.col("e"), F.col("kind"))), "mentions")
    named = mentions.where((F.col("kind") != "person") | F.col("norm").contains(" ")).groupBy("kind", "norm").agg(F.min("e").alias("e"))
    surnames = mentions.where("kind = 'person'").select(F.lit("surname").alias("kind"), _surname(F.col("norm")).alias("norm"), _surname(F.col("e")).alias("e")).groupBy("kind", "norm").agg(F.min("e").alias("e"))
    state = stash(named.unionByName(surnames).withColumn("attempt", F.lit(0)), "entities")
    e, k, n = F.col("e"), F.col("kind"), F.col("attempt")
    drawn_norm = (
        F.when(k == "surname", F.lower(surname_surrogate(e, n, key)))
        .when(k == "person", F.concat_ws("\x1f", _surname(F.col("norm")), F.lower(given_surrogate(e, n, key))))
        .otherwise(normal(surrogate(e, n, key), k))
    )
    for round_ in range(MOST_ROUNDS):
        drawn = state.withColumn("s_norm", drawn_norm)
        first = F.row_number().over(Window.partitionBy("kind", "s_norm").orderBy("attempt", "norm"))
        taken = state.select("kind", F.col("norm").alias("s_norm")).withColumn("taken", F.lit(True))
        checked = drawn.withColumn("place", first).join(taken, ["kind", "s_norm"], "left")
        again = (F.col("place") > 1) | F.coalesce("taken", F.lit(False))
        done = stash(checked.select("kind", "norm", "e", (n + again.cast("int")).alias("attempt"), again.alias("again")), "entities")
        if not done.where("again").limit(1).count():
            break
        state = done.drop("again")
    else:
        raise RuntimeError("surrogates still collide")
    if not round_:
        return None
    late = done.where("attempt > 0").select("kind", "norm", "attempt")
    by_name = late.where("kind <> 'surname'")
    by_surname = late.where("kind = 'surname'").select(F.col("norm").alias("last"), F.col("attempt").alias("surname_attempt"))
    last = F.when(k == "person", _surname(F.col("norm")))
    joined = mentions.withColumn("last", last).join(by_name, ["kind", "norm"], "left").join(by_surname, "last", "left")
    one, two = F.coalesce("attempt", F.lit(0)), F.coalesce("surname_attempt", F.lit(0))
    person = k == "person"
    return stash(joined.select("e", F.when(person, two).otherwise(one).alias("attempt"), F.when(person, one).otherwise(F.lit(0)).alias("given")).where("attempt > 0 or given > 0"), "attempts")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def replace(documents: DataFrame, text_col: str = "text", key: str = KEY, found_col: str = "pii_found") -> DataFrame:
    """The documents with surrogates in their texts, and a column with the detected types in order."""
    documents = documents.drop(found_col)
    more = attempts(documents, text_col, key)
    text = F.col(text_col)
    rows = documents.withColumn(found_col, entities(text))
    times = lambda e: (F.lit(0), F.lit(0))
    if more is not None:
        # rows without entities are dealt by all their columns, others by their texts
        id_, map_ = free_name(rows, "pii_row_key"), free_name(rows, "pii_attempts")
        rows = rows.withColumn(id_, F.when(F.size(found_col) > 0, F.xxhash64(text)).otherwise(F.xxhash64(*documents.columns)))
        each = rows.where(F.size(found_col) > 0).select(F.col(id_).alias("row"), F.explode(found_col).alias("e")).distinct().join(_few(more), "e")
        nth = each.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("e", F.struct("attempt", "given")))).alias(map_)).withColumnRenamed("row", id_)
        rows = rows.join(_few(stash(nth, "attempts")), id_, "left")

        def times(e: Column) -> tuple[Column, Column]:
            drawn = F.element_at(map_, e)
            return F.coalesce(drawn["attempt"], F.lit(0)), F.coalesce(drawn["given"], F.lit(0))

    def drawn(e: Column) -> Column:
        attempt, given = times(e)
        return surrogate(e, attempt, key, given)

    gaps = F.split(text, ANY, -1)
    built = F.array_join(F.zip_with(gaps, F.col(found_col), lambda g, e: F.concat(g, F.coalesce(F.when(e.isNotNull(), drawn(e)), F.lit("")))), "")
    out = rows.withColumn(text_col, F.when(F.size(found_col) > 0, built).otherwise(text)).withColumn(found_col, F.transform(found_col, kind))
    return out.select(*documents.columns, found_col)
