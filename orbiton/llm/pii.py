"""PII surrogates (operator 3), DataFrame functions only.

Detected entities are replaced by surrogates of their own type and format. An entity's canonical form
(letters and digits in lower case, fixed parts marked off) decides its surrogate, by a keyed SHA-256 digest, so that every
mention, in whatever document, case or punctuation, gets the same one. Over all canonical forms of the
corpus the surrogates are checked as they are written: where two forms meet in one surrogate, or a surrogate is itself a form
of the corpus, those draw again with the next attempt number, until none is left. Only the few that drew
again are joined to documents; every other surrogate is computed where the mention stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_spool, fresh, spool

#: Most draws of one form. A form that still collides after so many raises an error.
MOST_ATTEMPTS = 64
#: Overrides up to so many are broadcast to the documents; more are joined by shuffle.
BROADCAST_ROWS = 5_000

# Names for the surrogates of names, by script: given names by gender, family names, and what
# stands between given and family name. Han names start with the family name.
NAMES = {
    "Latin": (
        ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Lina", "Maria", "Nina", "Paula", "Sara", "Sofia"],
        ["Adam", "Bruno", "David", "Felix", "Hugo", "Jonas", "Leon", "Lukas", "Martin", "Oscar", "Paul", "Simon"],
        ["Alder", "Benson", "Carver", "Dalton", "Ellis", "Foster", "Garner", "Holden", "Irving", "Jarvis", "Keller", "Lorenz", "Marsh", "Norden", "Osborn", "Palmer"],
    ),
    "Cyrillic": (["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"], ["Антон", "Борис", "Виктор", "Иван", "Илья", "Олег", "Павел", "Роман"], ["Белов", "Волков", "Зайцев", "Лебедев", "Морозов", "Новиков", "Орлов", "Соколов"]),
    "Greek": (["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία"], ["Αλέξης", "Γιώργος", "Ηλίας", "Νίκος", "Πέτρος", "Σταύρος"], ["Αγγελίδης", "Βασιλείου", "Γεωργίου", "Δημητρίου", "Ιωάννου", "Νικολάου", "Παππάς", "Χρήστου"]),
    "Han": (["丽", "娜", "敏", "芳", "静", "婷"], ["伟", "强", "军", "磊", "勇", "杰"], ["李", "王", "张", "刘", "陈", "杨", "赵", "黄"]),
}
# Forms of address before a name, by gender; the last say nothing of it.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
TITLES = ["Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Professeur", "Profesor", "Profesora", "Доктор", "Профессор"]
# Given names that tell a name without a form of address, where another capitalised word follows.
KNOWN_FEMALE = "Alice Amelia Ana Andrea Anja Anna Barbara Camille Carmen Caroline Catherine Charlotte Chloé Christina Claire Clara Claudia Daniela Diana Elena Elisabeth Elizabeth Emily Emma Eva Fatima Hannah Helena Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Lena Linda Lisa Lucía Luisa Margaret Maria María Marie Martina Mary Monika Nadia Nicole Nina Olga Olivia Patricia Paula Petra Rachel Rosa Sabine Sandra Sara Sarah Silvia Sofia Sophie Stefanie Susan Teresa Ursula Valentina Victoria".split()
KNOWN_MALE = "Adam Ahmed Alan Alexander Ali Andreas Andrew Anthony Antonio Benjamin Carlos Charles Christian Christopher Daniel David Diego Edward Eric Fernando François Frank Fritz Georg George Giovanni Hans Henry Hugo Ivan Jack Jacques James Jan Javier Jean Johann John Jonas Jorge José Joseph Juan Jürgen Karl Kevin Klaus Lukas Manuel Marco Martin Matthew Michael Miguel Mohammed Nicolas Oliver Oscar Pablo Paul Pedro Peter Philipp Pierre Rafael Richard Robert Roberto Sebastian Sergio Stefan Stephen Steven Thomas Walter Werner William Wolfgang".split()



def _any_of(words: list[str]) -> str:
    """A pattern of the words that looks at a word's first letter before its others."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")"


_NAME_WORD = r"(?:\p{Lu}[\p{Ll}'’-]+|\p{IsHan}{2,4})"
# Between two digits of a number: an optional separator, brackets about it.
_GAP = r"\)?(?: ?[/-] ?|[ .])?\(?"
#: Layouts of telephone numbers, of 8 to 15 digits, the longer before the shorter where both may start.
_PHONES = [
    # Behind +: ten digits of North America, nine of France and Spain, any others.
    rf"\+1(?:{_GAP}[0-9]){{10}}(?![0-9])",
    rf"\+3[34](?:{_GAP}\(0\))?(?:{_GAP}[0-9]){{9}}(?![0-9])",
    rf"\+[0-9](?:{_GAP}[0-9]){{7,14}}(?![0-9])",
    # A code in brackets, then seven digits, or any number behind a German code.
    r"\([0-9]{2,4}\)[ ./-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}(?![0-9])",
    r"\(0[1-9][0-9]{0,4}\)(?: ?[/-] ?| )?[0-9](?:[ .-]?[0-9]){5,8}(?![0-9])",
    # Pairs of digits: France, then Spain. Longer rows of pairs are no numbers.
    r"(?<!(?<![0-9])[0-9]{2}[ .-])0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})(?!(?:[ .-][0-9]{2}){2}|[0-9])",
    r"(?<!(?<![0-9])[0-9]{2}[ .-])(?:[6-9][0-9]{2}(?:(?: [0-9]{2}){3}|(?:\.[0-9]{2}){3}|(?:-[0-9]{2}){3})|9[0-9] [0-9]{3}(?: [0-9]{2}){2})(?!(?:[ .-][0-9]{2}){2}|[0-9])",
    # Germany: a code with its 0, apart from the rest.
    r"(?<![0-9][.,])0[1-9][0-9]{1,4}(?: ?[/-] ?| )[0-9](?:[ .-]?[0-9]){4,8}(?![0-9])",
    # Three groups.
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}",
]
#: By type, in order of precedence, the pattern of an entity.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?i:password|passwd|pwd|token|secret|api_?key)(?:=| = | ?: ?)\"?[A-Za-z0-9+/_-]{8,}\"?)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])|(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?=[+(0-9])(?:" + "|".join(_PHONES) + r")(?![0-9])",
    "name": r"(?<![\p{L}])(?=\p{Lu})(?:" + _any_of([*FEMALE_TITLES, *MALE_TITLES, *TITLES]) + r"\.? " + _NAME_WORD + r"(?: " + _NAME_WORD + r"){0,2}|" + _any_of([*KNOWN_FEMALE, *KNOWN_MALE]) + r"(?: " + _NAME_WORD + r"){1,2})(?![\p{L}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has one of these; most texts have none and are spared PATTERN.
HINT = r"[@0-9=:]|(?<![\p{L}])(?=\p{Lu})(?:" + _any_of([*FEMALE_TITLES, *MALE_TITLES, *TITLES]) + r"\.?|" + _any_of([*KNOWN_FEMALE, *KNOWN_MALE]) + r") [\p{Lu}\p{IsHan}]"
#: A form of address before a name.
_TITLE = r"\A((?:" + "|".join([*FEMALE_TITLES, *MALE_TITLES, *TITLES]) + r")\.? )"

#: The country code at the start of a number behind +, by the ITU's list. No code starts another.
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_LAST_LABEL = r"(\.[A-Za-z]+)\z"

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def mentions(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))


def kind_of(e: Column) -> Column:
    """The type of an entity that PATTERN found."""
    out = F.lit("name")
    for name in reversed(list(PATTERNS)[:-1]):
        out = F.when(e.rlike(rf"\A(?:{PATTERNS[name]})\z"), name).otherwise(out)
    return out


def canonical(e: Column, kind: Column) -> Column:
    """What all mentions of one entity share, in lower case, without punctuation.

    Fixed parts that surrogates keep belong to it: a mail domain's last label behind its dot, the country
    code of a number as in "+49 301234567", an IBAN's country.
    """
    plain = F.regexp_replace(F.lower(e), r"[^\p{L}\p{N}]", "")
    body = F.lower(F.regexp_extract(e, r"\A(?:AKIA|[A-Za-z_]+(?:=| = | ?: ?)\"?)?([A-Za-z0-9+/_-]+)\"?\z", 1))
    label = F.lower(F.regexp_extract(e, _LAST_LABEL, 1))
    email = F.concat(F.regexp_replace(F.substring(F.lower(e), F.lit(1), F.length(e) - F.length(label)), r"[^a-z0-9]", ""), label)
    phone = F.when(e.startswith("+"), F.regexp_replace(F.regexp_replace(e, r"\(0\)|[^0-9]", ""), rf"\A({_COUNTRY})", r"+$1 ")).otherwise(plain)
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "secret", F.regexp_replace(body, r"[^a-z0-9]", "")).when(kind == "name", F.lower(F.regexp_replace(e, _TITLE, ""))).when(kind == "ip", F.lower(e)).otherwise(plain)


def _digest(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """192 hex digits that depend on the key, the type, the form and the attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256), F.sha2(F.concat(seed, F.lit("|3")), 256))


def _draw(digest: Column, i: Column, size: Column | int) -> Column:
    """The i-th number below size, from four hex digits; 48 of them, then again."""
    return (F.conv(F.substring(digest, ((i % 48) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long") % size).cast("int")


def _mapped(form: Column, digest: Column, hexadecimal: Column) -> Column:
    """form with each digit and letter drawn anew within its class; hex words stay hex."""
    def one(c: Column, i: Column) -> Column:
        h = _draw(digest, i, 260)
        digit, letter = c.between("0", "9"), c.between("a", "z")
        return F.when(digit, F.substring(F.lit(_DIGITS), h % 10 + 1, F.lit(1))).when(letter, F.substring(F.lit(_LOWER), h % F.when(hexadecimal, 6).otherwise(26) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10


def surrogate_form(kind: Column, form: Column, d: Column, attempt: Column, female: Column) -> Column:
    """The canonical form's surrogate, itself canonical but for the case of names; d is its digest."""
    mapped = _mapped(form, d, form.rlike(r"\A[0-9a-f]+\z"))
    # Cards keep their first digit, and their check digit stays right where it was.
    body = F.concat(F.substring(form, 1, 1), F.substring(mapped, F.lit(2), F.length(mapped) - 2))
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    card = F.concat(body, F.when(_luhn(form) == 0, check).otherwise((check + 1 + _draw(d, F.lit(47), 9)) % 10).cast("string"))
    # Telephone numbers keep their country code and don't start anew with 0.
    code = F.regexp_extract(form, r"\A(\+[0-9]+ )", 1)
    number = F.concat(code, F.when(F.substring(form, F.length(code) + 1, F.lit(1)) == "0", "0").otherwise((_draw(d, F.lit(46), 9) + 1).cast("string")), F.substring(mapped, F.length(code) + 2, F.length(mapped)))
    iban = F.concat(F.substring(form, 1, 2), F.substring(mapped, F.lit(3), F.length(mapped)))
    # Short addresses are few: from the fourth draw on their domains become longer.
    label = F.regexp_extract(form, _LAST_LABEL, 1)
    more = F.array_join(F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), attempt)), lambda i: F.substring(F.lit(_LOWER), _draw(d, 99 - i, 26) + 1, F.lit(1))), "")
    email = F.concat(F.substring(mapped, F.lit(1), F.length(form) - F.length(label)), F.when(attempt < 4, "").otherwise(more), label)
    hexes = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(F.lit("0123456789abcdef"), _draw(d, i, 16) + 1, F.lit(1)))), "")
    ip = F.when(form.contains(":"), hexes).otherwise(F.array_join(F.transform(F.split(form, r"\."), lambda _, i: (_draw(d, i, 253) + 1).cast("string")), "."))
    pick = lambda names, i: F.element_at(F.array(*(F.lit(x) for x in names)), _draw(d, i, len(names)) + 1)
    words = F.size(F.split(form, " "))
    name = None
    # Latin first: it stands for scripts that have no names here.
    for script, (women, men, families) in NAMES.items():
        given = F.when(female, pick(women, F.lit(0))).otherwise(pick(men, F.lit(0)))
        # Each later draw makes the family name one part longer, as the lists are finite and forms are not.
        between = "" if script == "Han" else "-"
        longer = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), attempt + 1)), lambda i: F.concat(F.lit(between), pick(families, i)))
        family = F.concat(pick(families, F.lit(1)), F.when(attempt == 0, "").otherwise(F.array_join(longer, "")))
        if script == "Han":
            found = F.when(words > 1, F.concat(family, F.lit(" "), given)).when(F.length(form) > 1, F.concat(family, given)).otherwise(family)
        else:
            found = F.when(words > 1, F.concat(given, F.lit(" "), family)).otherwise(family)
        name = found if name is None else F.when(form.rlike(rf"\p{{Is{script}}}"), found).otherwise(name)
    return F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", number).when(kind == "name", name).otherwise(mapped)


def _is_female(e: Column) -> Column:
    """The gender that a mention tells: by its form of address, or else by a known given name."""
    bare = F.regexp_replace(e, _TITLE, "")
    return e.rlike(r"\A(?:" + "|".join(FEMALE_TITLES) + r")\b") | (~e.rlike(r"\A(?:" + "|".join(MALE_TITLES) + r")\b") & bare.rlike(r"\A(?:" + "|".join(KNOWN_FEMALE) + r")(?:\s|\z)"))


def dressed(e: Column, kind: Column, form: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention: its punctuation, spacing and case; fixed parts stay.

    The last label of a mail domain, a country code behind +, an IBAN's country, the word before a secret
    and a name's form of address are fixed parts.
    """
    keep = F.when(kind == "secret", F.length(F.regexp_extract(e, r"\A(AKIA|[A-Za-z_]+(?:=| = | ?: ?)\"?)", 1))).otherwise(0)
    label = F.regexp_extract(e, _LAST_LABEL, 1)
    stop = F.length(e) - F.when(kind == "email", F.length(label)).otherwise(0)
    letters = F.when(kind == "phone", F.regexp_replace(surrogate, "[^0-9]", "")).otherwise(surrogate)
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("k"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        part = c.between("0", "9") | c.between("a", "z") | c.between("A", "Z")
        new = F.substring(letters, a["k"] + F.when(kind == "secret", 1 - keep).otherwise(1), F.lit(1))
        new = F.when(c.between("A", "Z"), F.upper(new)).otherwise(new)
        inside = (a["i"] >= keep) & (a["i"] < stop)
        counts = F.when(kind == "secret", F.lit(True)).otherwise(part)
        return F.struct(F.concat(a["o"], F.when(part & inside, new).otherwise(c)).alias("o"), (a["k"] + F.when(counts & (part | (a["i"] < keep)), 1).otherwise(0)).alias("k"), (a["i"] + 1).alias("i"))

    # A (0) within an international number is for dialling at home and no digit of it.
    trunk = (kind == "phone") & e.startswith("+") & e.contains("(0)")
    filled = F.aggregate(F.split(F.when(trunk, F.replace(e, F.lit("(0)"), F.lit("()"))).otherwise(e), ""), start, step, lambda a: a["o"])
    filled = F.when(trunk, F.replace(filled, F.lit("()"), F.lit("(0)"))).otherwise(filled)
    # What a later draw added to an address goes before the last label.
    more = F.substring(surrogate, F.length(form) - F.length(label) + 1, F.length(surrogate) - F.length(form))
    email = F.concat(F.substring(filled, F.lit(1), stop), more, label)
    return F.when(kind == "email", email).when(kind == "ip", surrogate).when(kind == "name", F.concat(F.regexp_extract(e, _TITLE, 1), surrogate)).otherwise(filled)


def _described(entities: Column) -> Column:
    """Array of (e, kind, form, female); each step's values are computed once. female: a given name to draw is."""
    kinds = F.transform(entities, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), canonical(x["e"], x["kind"]).alias("form"), (_is_female(x["e"]) & (x["kind"] == "name") & (F.regexp_replace(x["e"], _TITLE, "").rlike(r" |\p{IsHan}{2}"))).alias("female")))


def _entry(kind: Column, form: Column, female: Column) -> Column:
    """What an override is known by."""
    return F.concat_ws("|", kind, female.cast("string"), form)


def _forms(docs: DataFrame) -> DataFrame:
    """(kind, form, female) of every entity of the corpus, once each, counted down before any shuffle."""
    found = docs.select(F.explode(F.array_distinct(_described(mentions(F.col("text"))))).alias("x")).select("x.kind", "x.form", "x.female")
    # Full names of both genders are checked by gender, as that decides what is written.
    # A secret of punctuation alone has nothing to replace.
    return found.where("form <> ''").distinct()


def overrides(docs: DataFrame, key: str) -> DataFrame:
    """(kind, form, female, attempt, surrogate): the forms that had to draw again, as a written table."""
    forms = _forms(docs).withColumn("attempt", F.lit(0))
    def draw(df: DataFrame) -> DataFrame:
        digest = F.array(_digest(key, F.col("kind"), F.col("form"), F.col("attempt")))
        return df.withColumn("surrogate", F.transform(digest, lambda d: surrogate_form(F.col("kind"), F.col("form"), d, F.col("attempt"), F.col("female")))[0])

    table = spool(draw(forms))
    for _ in range(MOST_ATTEMPTS):
        # Of the forms that meet in one surrogate the least keeps it; one that is a form of the corpus nobody keeps.
        shared = table.groupBy("kind", F.lower("surrogate").alias("s")).agg(F.min(F.struct("form", "female")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        real = table.select("kind", F.col("form").alias("s")).join(table.select("kind", F.lower("surrogate").alias("s")), ["kind", "s"], "left_semi").select("kind", "s", F.lit(None).cast("struct<form:string,female:boolean>").alias("first"))
        clash = shared.select("kind", "s", "first").unionByName(real).groupBy("kind", "s").agg(F.min(F.struct(F.col("first").isNotNull(), "first")).alias("x")).select("kind", "s", F.col("x.first").alias("first"))
        clash = spool(clash)
        if not clash.limit(1).count():
            drop_spool(clash)
            return table.where("attempt > 0")
        again = table.withColumn("s", F.lower("surrogate")).join(clash, ["kind", "s"], "left_semi").join(clash, ["kind", "s"]).where(F.col("first").isNull() | (F.struct("form", "female") != F.col("first"))).select("kind", "form", "female", (F.col("attempt") + 1).alias("attempt"))
        after = spool(table.join(again.select("kind", "form", "female"), ["kind", "form", "female"], "left_anti").unionByName(draw(again)))
        drop_spool(table, clash)
        table = after
    raise ValueError(f"surrogates still collide after {MOST_ATTEMPTS} draws")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with each entity of `text` replaced by its surrogate; the other columns stay. Adds nothing.

    key: a secret; who has it can tell by trying which form a surrogate stands for. A null text stays null;
    texts without entities stay as they are; repeated rows are treated alike; an empty table stays empty;
    columns of any name are kept. n_chars, if there is such a column, is not counted anew.
    """
    names = docs.columns
    found, over, hashed, whole = (fresh(names, c) for c in ("_e", "_again", "_t", "_text"))
    again = overrides(docs.select("text"), key)
    n = again.limit(BROADCAST_ROWS + 1).count()
    work = docs.withColumn(found, mentions(F.col("text")))
    if n:
        again = again.select(_entry(F.col("kind"), F.col("form"), F.col("female")).alias("k"), "surrogate")
        if n <= BROADCAST_ROWS:
            # At most BROADCAST_ROWS rows of two short strings.
            table = again.agg(F.map_from_entries(F.collect_list(F.struct("k", "surrogate"))).alias(over))
            work = work.crossJoin(F.broadcast(table))
        else:
            own = docs.select("text").where(F.size(mentions(F.col("text"))) > 0).distinct()
            own = own.select("text", F.explode(_described(F.array_distinct(mentions(F.col("text"))))).alias("x")).select("text", "x.*")
            own = own.withColumn("k", _entry(F.col("kind"), F.col("form"), F.col("female")))
            maps = own.join(again, "k").select("text", "k", "surrogate").distinct().groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("k", "surrogate"))).alias(over))
            # By the text itself: its hash only spreads the rows.
            maps = maps.select(F.xxhash64("text").alias(hashed), F.col("text").alias(whole), over)
            work = work.join(maps, (F.xxhash64(work["text"]) == maps[hashed]) & (work["text"] == maps[whole]), "left").drop(hashed, whole)
    else:
        work = work.withColumn(over, F.lit(None).cast("map<string,string>"))

    zero = F.lit(0)
    known = F.transform(_described(F.col(found)), lambda x: F.struct(*(x[c].alias(c) for c in ("e", "kind", "form", "female")), F.element_at(F.col(over), _entry(x["kind"], x["form"], x["female"])).alias("over"), _digest(key, x["kind"], x["form"], zero).alias("d")))
    drawn = F.transform(known, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["form"].alias("form"), F.coalesce(x["over"], surrogate_form(x["kind"], x["form"], x["d"], zero, x["female"])).alias("s")))
    placed = F.transform(drawn, lambda x: dressed(x["e"], x["kind"], x["form"], x["s"]))
    between = F.split("text", PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, placed, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    return work.withColumn("text", F.when(F.size(found) > 0, joined).otherwise(F.col("text"))).select(*names)


def session_key(spark) -> str:
    """The key that the session names in spark.orbiton.pii.key; without one, a word for trials, which hides nothing."""
    return spark.conf.get("spark.orbiton.pii.key", "trial")
