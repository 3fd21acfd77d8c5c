"""Surrogates for personal data, in SQL functions only.

Detected entities (mail addresses, names behind a form of address, IBANs, secrets, social security numbers, IP
addresses, card numbers, telephone numbers) are replaced by made-up ones of the same type. A surrogate follows from a
secret key and the entity itself, so the same entity gets the same surrogate everywhere, in every spelling:
numbers are compared by their digits and written into the form found, names word by word. Formats stay: lengths,
separators, country codes, script and gender of names, the check digits of cards and IBANs. Two entities never share
a surrogate, and no surrogate is an entity of the input: where a draw collides, one of them draws again. What still
collides after ``DRAWS`` draws (formats with few values) is matched by rank with the free values of its format, which
are counted through in a keyed order; an entity for which its format has no free value gets a longer one.

Words of a name that was found are replaced wherever they stand in the same text, also without a form of address.

Only rows that hold an entity are taken apart and joined with the table of surrogates; all others pass as they are.

Nulls and odd input: a null text stays null. Rows equal in doc_id and text are rewritten alike, each of them. Texts are
read whole. An empty table gives no rows. All input columns ride along in ``row``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotbook.llm.rows import carried
from lotbook.operators.rows import with_row_id
from lotbook.session import staged

MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Doña", "госпожа")
OTHER = ("Dr", "Prof", "Professor", "Doctor")
_TITLES = "|".join(sorted(MALE + FEMALE + OTHER, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
#: Scripts whose texts have no capitals and that set words apart by spaces: one word is the name, as nothing tells where more of it end.
_BARE = r"[[\p{IsHebrew}\p{IsArabic}\p{IsDevanagari}\p{IsGeorgian}]&&[\p{L}\p{M}]]{2,}+"
_WORD = rf"(?<![\p{{L}}\p{{M}}])(?:{_NAME}|{_BARE})"
_AFTER = r"(?:['’][sS])?['’-]*$"  # of a name word: a genitive, the end of a quotation
#: In this order, if several fit at one place. Each begins at the start of a run of its characters, so reading stays linear.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? (?:{_NAME}(?: {_NAME}){{0,2}}|{_BARE})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": (
        r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
        r"|\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\w]|[.-][0-9])"
    ),
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
LATIN = "ba be bi bo da de di do fa fe fi ga go ha he ja jo ka ke ki la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se ta te va".split()
CYRILLIC = "ба бе би бо да де ди до ва ве га го жа за зе ка ки ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те фа ха".split()
BEATS = {  # syllables of names; no one begins another of its script
    "latin": LATIN, "cyrillic": CYRILLIC,
    "greek": "βα βε γα γε δα δε ζα ζο θα θε κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε".split(),
    "armenian": "բա բե գա գե դա դե զա կա կե կո լա լե լի լո մա մե մի մո նա նե նի նո պա պե ռա ռե սա սե սո տա տե վա վե".split(),
    "georgian": "ბა ბე გა გე და დე ზა კა კე კო ლა ლე ლი ლო მა მე მი მო ნა ნე ნი ნო პა პე რა რე სა სე სო ტა ტე ვა ვე".split(),
    "hebrew": "בא בו גא גו דא דו זא זו לא לו מא מו נא נו סא סו פא פו רא רו שא שו תא תו".split(),
    "arabic": "با بو تا تو جا جو دا دو را رو زا زو سا سو فا فو كا كو لا لو ما مو نا نو يا يو".split(),
    "devanagari": "बा बे गा गे दा दे का के ला ले मा मे ना ने पा पे रा रे सा से ता ते वा वे".split(),
}
ENDS = {  # of a given name or surname, by script: one that tells the gender, or none
    ("latin", "male"): ("rd", "n", "s", "rt"), ("latin", "female"): ("na", "ra", "la", "lia"), ("latin", "other"): ("x", "ry", "le", "my"),
    ("latin", "surname"): ("sen", "mann", "ton", "rez", "ck", "ld"),
    ("cyrillic", "male"): ("н", "р", "слав", "й"), ("cyrillic", "female"): ("на", "я", "ра", "ла"), ("cyrillic", "other"): ("ша", "ня", "ка", "ся"),
    ("cyrillic", "surname"): ("енко", "ых", "ук", "ич"),
    ("greek", "male"): ("ος", "ης", "ων", "ας"), ("greek", "female"): ("να", "ια", "ρη", "λω"), ("greek", "other"): ("ξι", "φι", "χι", "ψι"),
    ("greek", "surname"): ("πουλος", "ιδης", "ακης", "ογλου"),
    ("armenian", "male"): ("ն", "ր", "կ", "մ"), ("armenian", "female"): ("նա", "րա", "լա", "իկ"), ("armenian", "other"): ("շի", "չի", "ջի", "ցի"),
    ("armenian", "surname"): ("նյան", "րյան", "լյան", "ունց"),
    ("georgian", "male"): ("ზი", "რი", "ნდი", "გი"), ("georgian", "female"): ("ნა", "კო", "ლა", "ია"), ("georgian", "other"): ("ში", "ჩი", "ჯი", "ცი"),
    ("georgian", "surname"): ("შვილი", "ძე", "ია", "ური"),
    ("hebrew", "male"): ("ן", "ם", "ל", "ר"), ("hebrew", "female"): ("ה", "ית", "נה", "לה"), ("hebrew", "other"): ("י", "ק", "ט", "ב"),
    ("hebrew", "surname"): ("מן", "ברג", "סקי", "ני"),
    ("arabic", "male"): ("د", "ر", "ن", "م"), ("arabic", "female"): ("ة", "اء", "ية", "ى"), ("arabic", "other"): ("ح", "ج", "ق", "ط"),
    ("arabic", "surname"): ("اوي", "اني", "وري", "يدي"),
    ("devanagari", "male"): ("न", "र", "म", "श"), ("devanagari", "female"): ("ती", "ना", "ली", "या"), ("devanagari", "other"): ("क", "ज", "ह", "द"),
    ("devanagari", "surname"): ("कर", "वाल", "शर्म", "गुप्त"),
}
DRAWS = 8  # rounds of chance; after them free values are counted through
BLOCK = 4096  # values that one row is spread to
#: What a place of a format can hold, by a sign that no entity has at such a place.
PLACES = {"#": list("0123456789"), "?": [chr(97 + i) for i in range(26)], "!": [chr(65 + i) for i in range(26)], "*": list("0123456789abcdef"),
          "=": list("123456789"), "~": [str(i) for i in range(1, 255)]}


def _kind(match: Column) -> Column:
    out = F.lit("phone")
    for name, pattern in reversed(list(PATTERNS.items())):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _stream(seed: Column, length: Column) -> Column:
    """At least ``length`` hexadecimal digits that follow from ``seed``."""
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(length, F.lit(1)) - 1) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(seed, F.lit(":"), b.cast("string")), 256)), "")


def _number(stream: Column, at: Column, digits: int = 2) -> Column:
    return F.conv(F.substring(stream, at * digits + 1, F.lit(digits)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shaped(text: Column, seed: Column) -> Column:
    """Digits for digits and small letters for small letters; all else stays."""
    stream = _stream(seed, F.length(text) * 2)

    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.chr(_number(stream, i) % 10 + 48)).when(c.rlike("[a-z]"), F.chr(_number(stream, i) % 26 + 97)).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Of the number that letters and digits spell (A = 10)."""
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(text), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97)


def _check(body: Column) -> Column:
    """The digit that makes a card number valid."""
    return F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))


def _checked(country: Column, inner: Column) -> Column:
    return F.concat(country, F.lpad((98 - _mod97(F.concat(inner, country, F.lit("00")))).cast("string"), 2, "0"), inner)


def _mail(canon: Column) -> tuple[Column, Column, Column]:
    """What stands before the sign, the domain without its last label, and that label."""
    domain = F.substring_index(canon, "@", -1)
    last = F.substring_index(domain, ".", -1)
    return F.substring_index(canon, "@", 1), F.substring(domain, F.lit(1), F.length(domain) - F.length(last)), last


def _front(front: Column, key: str) -> Column:
    return _shaped(front, F.concat(F.lit(key), F.lit("|domain|"), front))


def _script(canon: Column) -> Column:
    """Of the first letter of one that is known here, else Latin."""
    out = F.lit("latin")
    for name in BEATS:
        if name != "latin":
            out = F.when(canon.rlike(rf"^\P{{L}}*\p{{Is{name.capitalize()}}}"), F.lit(name)).otherwise(out)
    return out


def _beats(script: Column) -> Column:
    return F.element_at(F.create_map(*[x for name, beats in BEATS.items() for x in (F.lit(name), F.array(*[F.lit(b) for b in beats]))]), script)


def _ends(script: Column, role: Column) -> Column:
    table = F.create_map(*[x for (name, part), ends in ENDS.items() for x in (F.lit(f"{name}.{part}"), F.array(*[F.lit(e) for e in ends]))])
    return F.element_at(table, F.concat_ws(".", script, role))


def _name(canon: Column, seed: Column, role: Column) -> Column:
    script = _script(canon)
    stream = _stream(seed, F.lit(32))
    pick = lambda items, at: F.element_at(items, F.pmod(F.conv(F.substring(stream, 6 * at + 1, 6), 16, 10).cast("int"), F.size(items)) + 1)
    return F.concat(*[pick(_beats(script), at) for at in range(4)], pick(_ends(script, role), 4))


def draw(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity in its plain form."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    stream = _stream(seed, F.length(canon) * 2 + 64)
    fresh = lambda n, offset=0: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: (_number(stream, i + offset) % 10).cast("string")), "")
    length = F.length(canon)

    local, front, last = _mail(canon)
    mail = F.concat(_shaped(local, seed), F.lit("@"), _front(front, key), last)

    body = F.concat(F.substring(canon, 1, 1), fresh(length - 2))
    card = F.concat(body, F.when(F.pmod(_luhn(canon), F.lit(10)) == 0, _check(body).cast("string")).otherwise(fresh(F.lit(1), 40)))

    area = F.greatest(length - 10, F.lit(0))
    phone = F.concat(F.substring(canon, F.lit(1), area), fresh(length - area))
    ssn = F.concat(F.lit("9"), fresh(length - 1))
    octet = lambda i: (_number(stream, F.lit(i)) % 254 + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    hexes = F.substring(stream, F.lit(1), length)

    country, account = F.substring(canon, 1, 2), F.substring(canon, F.lit(5), length)
    inner = F.array_join(F.transform(_chars(account), lambda c, i: F.when(c.rlike("[0-9]"), F.chr(_number(stream, i) % 10 + 48)).otherwise(F.chr(_number(stream, i) % 26 + 65))), "")
    iban = _checked(country, inner)

    choices = {"mail": mail, "card": card, "phone": phone, "ssn": ssn, "ip": ip, "secret": hexes, "iban": iban}
    named = _name(canon, seed, F.substring_index(kind, ".", -1))
    return reduce(lambda out, c: F.when(kind == c[0], c[1]).otherwise(out), choices.items(), named)


def _format(kind: Column, canon: Column, key: str, wider: int) -> tuple[Column, Column]:
    """The places of an entity's surrogate, and what else it follows from; ``wider`` places more than the entity has."""
    length = F.length(canon)
    places = lambda n, sign="#": F.repeat(F.lit(sign), n)
    local, front, last = _mail(canon)
    valid = F.pmod(_luhn(canon), F.lit(10)) == 0
    area = F.greatest(length - 10, F.lit(0))
    account = F.regexp_replace(F.substring(canon, F.lit(5), length), "[0-9]", "#")
    templates = {
        "mail": F.concat(F.regexp_replace(F.regexp_replace(local, "[0-9]", "#"), "[a-z]", "?"), F.lit("?" * wider)),
        "card": F.concat(F.substring(canon, 1, 1), places(length - 2 + wider), F.when(valid, "").otherwise("=")),
        "phone": F.concat(F.substring(canon, F.lit(1), area), places(length - area + wider)),
        "ssn": F.concat(F.lit("9"), places(length - 1 + wider)), "ip": F.lit("~.~.~.~" + ".~" * wider),
        "secret": places(length + wider, "*"), "iban": F.concat(F.regexp_replace(account, "[A-Z]", "!"), F.lit("#" * wider)),
    }
    frames = {"mail": F.concat(F.lit("@"), _front(front, key), last), "card": F.when(valid, "valid").otherwise("odd"),
              "iban": F.substring(canon, 1, 2), **{k: F.lit("") for k in ("phone", "ssn", "ip", "secret")}}
    pick = lambda table, other: reduce(lambda out, c: F.when(kind == c[0], c[1]).otherwise(out), table.items(), other)
    return pick(templates, F.lit("$" * (4 + wider) + "^")), pick(frames, _script(canon))


def _value(kind: Column, template: Column, frame: Column, key: str, number: Column) -> Column:
    """value, rest: the value of that number in a format; rest is 0 if there are so many. No two numbers give one value."""
    stream = _stream(F.concat_ws("|", F.lit(key), F.lit("format"), kind, template, frame), F.length(template) * 4)
    role = F.substring_index(kind, ".", -1)
    texts = lambda items: F.array(*[F.lit(i) for i in items])

    def held(sign: Column) -> Column:
        out = F.when(sign == "$", _beats(frame)).when(sign == "^", _ends(frame, role))
        for c, items in PLACES.items():
            out = out.when(sign == c, texts(items))
        return out

    signs = F.reverse(F.transform(_chars(template), lambda c, i: F.struct(held(c).alias("items"), c.alias("sign"), i.alias("at"))))
    none = F.struct(F.lit("").alias("value"), number.cast("bigint").alias("rest"))

    def more(state: Column, place: Column) -> Column:
        many = F.size(place["items"]).cast("bigint")
        drawn = F.element_at(place["items"], (F.pmod(state["rest"] + _number(stream, place["at"], 4), many) + 1).cast("int"))
        rest = F.when(place["items"].isNull(), state["rest"]).otherwise(F.floor((state["rest"] - F.pmod(state["rest"], many)) / many))
        return F.struct(F.concat(F.coalesce(drawn, place["sign"]), state["value"]).alias("value"), rest.cast("bigint").alias("rest"))

    filled = F.aggregate(signs, none, more)
    text = filled["value"]
    body = F.when(frame == "odd", F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    off = F.when(frame == "odd", F.substring(text, -1, 1).cast("int")).otherwise(0)  # a wrong check digit stays a wrong one
    card = F.concat(body, F.pmod(_check(body) + off, F.lit(10)).cast("string"))
    whole = F.when(kind == "mail", F.concat(text, frame)).when(kind == "card", card).when(kind == "iban", _checked(frame, text)).otherwise(text)
    return F.struct(whole.alias("value"), filled["rest"].alias("rest"))


def _group(kind: Column, value: Column) -> Column:
    """Values of one format are in one group."""
    local = F.length(F.substring_index(value, "@", 1)).cast("string")
    return F.when(kind == "mail", F.concat(local, F.lit("@"), F.substring_index(value, "@", -1))).when(
        kind.startswith("name") | (kind == "ip"), "").otherwise(F.length(value).cast("string"))


def _ranked(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rank: the place of a row among those with equal ``by``, from 0 on, without a window over a group."""
    rows = staged(with_row_id(rows, [*by, order], "place"), "ranked")
    firsts = rows.groupBy(*by).agg(F.min("place").alias("start"))
    return rows.join(firsts, by).withColumn("rank", F.col("place") - F.col("start")).drop("place", "start")


def _counted_through(made: DataFrame, clash: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Surrogates for the entities of ``clash``: free values of their formats, or of the next longer ones that have some."""
    columns = ["kind", "canon", "attempt", "surrogate"]
    placed = made.join(clash, ["kind", "canon"], "left_anti").select(columns)
    left = clash.select("kind", "canon")
    by, wider = ["kind", "template", "frame"], 0
    kind = F.col("kind")
    while not left.isEmpty():
        taken = staged(placed.select("kind", F.col("surrogate").alias("value")).unionAll(entities.select("kind", F.col("canon").alias("value"))), "taken")
        template, frame = _format(kind, F.col("canon"), key, wider)
        waiting = staged(left.select("kind", "canon", template.alias("template"), frame.alias("frame")), "waiting")
        first = _value(kind, F.col("template"), F.col("frame"), key, F.lit(0))["value"]
        formats = waiting.groupBy(by).agg(F.count("*").alias("n")).withColumn("group", _group(kind, first))
        held = taken.groupBy("kind", _group(kind, F.col("value")).alias("group")).agg(F.count("*").alias("held"))
        # so many values hold a free one for each that waits, if the format has so many
        formats = formats.join(held, ["kind", "group"], "left").withColumn("n", F.col("n") + F.coalesce("held", F.lit(0)))
        spread = formats.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK))).alias("b")).repartition(by[0], "template", "b")
        numbers = spread.select(*by, F.explode(F.sequence(F.col("b") * BLOCK, F.least(F.col("n"), (F.col("b") + 1) * BLOCK) - 1)).alias("number"))
        values = numbers.select(*by, _value(kind, F.col("template"), F.col("frame"), key, F.col("number")).alias("v")).where("v.rest = 0")
        free = values.select(*by, F.col("v.value").alias("value")).join(taken, ["kind", "value"], "left_anti")
        keyed = lambda c: F.sha2(F.concat_ws("|", F.lit(key), kind, F.col(c)), 256)
        waits = _ranked(waiting.withColumn("h", keyed("canon")), by, "h").drop("h")
        offers = _ranked(free.withColumn("h", keyed("value")), by, "h").drop("h")
        found = staged(waits.join(offers, [*by, "rank"], "left").select("kind", "canon", "value"), "found")
        placed = placed.unionAll(found.where("value is not null").select("kind", "canon", F.lit(DRAWS + wider).alias("attempt"), F.col("value").alias("surrogate")))
        left = found.where("value is null").select("kind", "canon")
        wider += 1
    return placed


def _capitals(shown: Column, surrogate: Column) -> Column:
    return F.when(shown == F.upper(shown), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def _stem(word: Column) -> Column:
    return F.regexp_replace(word, _AFTER, "")


def _mentions(segment: Column, known: Column) -> Column:
    """text, n: a text without matches with the words in ``known`` (plain form -> surrogate) replaced, and how many."""

    def one(word: Column) -> Column:
        stem = F.when(F.element_at(known, F.lower(word)).isNotNull(), word).otherwise(_stem(word))
        surrogate = F.element_at(known, F.lower(stem))
        return F.struct(F.concat(_capitals(stem, surrogate), F.substring(word, F.length(stem) + 1, F.length(word))).alias("new"), word.alias("old"))

    words = F.transform(F.regexp_extract_all(segment, F.lit(_WORD), F.lit(0)), one)
    gaps = F.split(segment, _WORD, -1)
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(words, i)["new"], F.get(words, i)["old"], F.lit("")))), "")
    return F.struct(text.alias("text"), F.size(F.filter(words, lambda w: w["new"].isNotNull())).alias("n"))


def dressed(kind: Column, shown: Column, surrogate: Column) -> Column:
    """The surrogate in the form that was found."""
    signs = lambda text: F.regexp_replace(text, "[^0-9A-Za-z]", "")
    before = lambda i: F.length(signs(F.substring(shown, F.lit(1), i + 1)))
    digits_before = lambda i: F.length(_digits(F.substring(shown, F.lit(1), i + 1)))
    spaced = F.array_join(F.transform(_chars(shown), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(surrogate, before(i), F.lit(1))).otherwise(c)), "")
    numbered = F.array_join(F.transform(_chars(shown), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, digits_before(i), F.lit(1))).otherwise(c)), "")
    # a surrogate of a format without a free value is longer than what was found
    spaced = F.concat(spaced, F.substring(surrogate, F.length(signs(shown)) + 1, F.length(surrogate)))
    numbered = F.concat(numbered, F.substring(surrogate, F.length(_digits(shown)) + 1, F.length(surrogate)))
    plain = F.when((shown == F.upper(shown)) & (shown != F.lower(shown)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("card", "phone", "ssn"), numbered).when(kind == "iban", spaced).when(kind.startswith("name"), _capitals(shown, surrogate)).otherwise(plain)


def units(matches: DataFrame) -> DataFrame:
    """What is replaced as one: a whole match, or each word of a name; lead is what stands before it, trail behind it.

    Adds u, kind, canon, shown, lead, trail to ``matches`` (match).
    """
    match, kind = F.col("match"), _kind(F.col("match"))
    title = F.regexp_extract(match, rf"^({_TITLES})\.? ", 1)
    gender = F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female").otherwise("other")
    opening = F.regexp_extract(match, rf"^((?:{_TITLES})\.? )", 1)
    names = F.split(F.substring(match, F.length(opening) + 1, F.length(match)), " ")

    def word(w: Column, i: Column) -> Column:
        part = F.when(i == F.size(names) - 1, F.lit("name.surname")).otherwise(F.concat(F.lit("name."), gender))
        return F.struct(part.alias("kind"), F.lower(_stem(w)).alias("canon"), _stem(w).alias("shown"),
                        F.when(i == 0, opening).otherwise(F.lit(" ")).alias("lead"), F.substring(w, F.length(_stem(w)) + 1, F.length(w)).alias("trail"))

    canon = F.when(kind.isin("card", "phone", "ssn"), _digits(match)).when(kind == "iban", F.regexp_replace(match, " ", "")).when(
        kind == "ip", match).otherwise(F.lower(match))
    whole = F.array(F.struct(kind.alias("kind"), canon.alias("canon"), match.alias("shown"), F.lit("").alias("lead"), F.lit("").alias("trail")))
    return matches.select("*", F.posexplode(F.when(kind == "name", F.transform(names, word)).otherwise(whole)).alias("u", "e")).select(
        *matches.columns, "u", "e.*")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate: distinct within a kind, and none of them an entity of the kind."""
    entities = staged(entities.distinct(), "entities")
    made = staged(entities.select("kind", "canon", F.lit(0).alias("attempt"), draw(F.col("kind"), F.col("canon"), key, F.lit(0)).alias("surrogate")), "surrogates")
    for attempt in range(DRAWS):
        first = made.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n"))
        shared = made.join(first.where("n > 1"), ["kind", "surrogate"]).where("first.canon <> canon").select("kind", "canon")
        real = made.join(entities.withColumnRenamed("canon", "surrogate"), ["kind", "surrogate"], "left_semi").select("kind", "canon")
        clash = staged(shared.unionAll(real).distinct().withColumn("clash", F.lit(True)), "clashes")
        if clash.isEmpty():
            return made
        if attempt == DRAWS - 1:
            return _counted_through(made, clash, entities, key)
        again = made.join(clash, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce(F.col("clash").cast("int"), F.lit(0)))
        drawn = draw(F.col("kind"), F.col("canon"), key, F.col("attempt"))
        made = staged(again.select("kind", "canon", "attempt", F.when(F.col("clash"), drawn).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """row, text (rewritten), n_replaced, kinds (how many of each type, as type=count,...)."""
    rows = docs.select(carried(docs), F.col("text").alias("_text"))
    found = F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))
    rows = rows.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    held = rows.where(F.size("_found") > 0)
    # written down, so that the number of a row stays as it is
    held = staged(held.select(F.monotonically_increasing_id().alias("_n"), "row", "_text", "_found"), "held")
    matches = held.select("_n", F.posexplode("_found").alias("at", "match"))
    parts = staged(units(matches), "parts")
    table = surrogates(parts.select("kind", "canon"), key)
    pieces = parts.join(table.select("kind", "canon", "surrogate"), ["kind", "canon"])
    # a word that is both in a text is a given name there
    names = pieces.where(F.col("kind").startswith("name")).groupBy("_n", "canon").agg(F.min(F.struct("kind", "surrogate"))["surrogate"].alias("surrogate"))
    names = names.groupBy("_n").agg(F.map_from_entries(F.collect_list(F.struct("canon", "surrogate"))).alias("names"))
    pieces = pieces.select("_n", "at", "u", "kind", F.concat("lead", dressed(F.col("kind"), F.col("shown"), F.col("surrogate")), "trail").alias("piece"))
    whole = pieces.groupBy("_n", "at").agg(F.array_sort(F.collect_list(F.struct("u", "piece"))).alias("p"), F.min("kind").alias("kind"))
    whole = whole.select("_n", "at", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("piece"), F.substring_index("kind", ".", 1).alias("kind"))
    lists = whole.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "kind"))).alias("new"))  # at most the matches of a text
    joined = held.join(lists.join(names, "_n", "left"), "_n").withColumn("_rest", F.split("_text", ANY, -1))
    untouched = F.transform("_rest", lambda s: F.struct(s.alias("text"), F.lit(0).alias("n")))
    mentioned = F.when(F.col("names").isNull(), untouched).otherwise(F.transform("_rest", lambda s: _mentions(s, F.col("names"))))
    joined = joined.withColumn("_rest", mentioned).withColumn("_more", F.aggregate("_rest", F.lit(0), lambda n, s: n + s["n"]))
    text = F.array_join(F.transform("_rest", lambda s, i: F.concat(s["text"], F.coalesce(F.get("new", i)["piece"], F.lit("")))), "")
    of = lambda k: F.size(F.filter("new", lambda m: m["kind"] == k)) + (F.col("_more") if k == "name" else 0)
    counted = F.filter(F.array(*[F.concat(F.lit(f"{k}="), of(k).cast("string")) for k in sorted(PATTERNS)]), lambda c: ~c.endswith("=0"))
    counted = F.array_join(counted, ",")
    rewritten = joined.select("row", text.alias("text"), (F.size("new") + F.col("_more")).alias("n_replaced"), counted.alias("kinds"))
    others = rows.where(F.size("_found") == 0).select("row", F.col("_text").alias("text"), F.lit(0).alias("n_replaced"), F.lit("").alias("kinds"))
    return rewritten.unionAll(others)
