"""Personal data and secrets replaced by surrogates, in DataFrame functions.

Entities are found by patterns and cut into parts (a name's words, an email's user and domain, a secret behind its key). Every part gets a keyed
surrogate of the same form, the same one wherever it stands; parts that would get an equal one, or one that the corpus
holds as an original, are drawn again.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_salted, save_table

# Forms of address by gender, and given names by script and gender.
MALE_TITLES = "Mr Mister Sir Herr Monsieur Señor Sr Don господин".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Señorita Doña госпожа".split()
OTHER_TITLES = "Dr Prof Professor Doctor Docteur Doktor Доктор".split()
GIVEN = {
    "given_male_latin": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth George Edward Brian Kevin Jason Hans Jürgen Klaus Wolfgang Stefan Pierre Jacques Philippe François Michel Carlos Miguel Javier Alejandro Fernando".split(),
    "given_female_latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Sandra Ashley Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Ursula Monika Brigitte Sabine Claudia Catherine Isabelle Nathalie Sophie Camille Carmen Lucía Isabel Pilar Dolores".split(),
    "given_male_cyrillic": "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел".split(),
    "given_female_cyrillic": "Елена Ольга Наталья Татьяна Ирина Анна Мария Светлана Екатерина Людмила".split(),
}
# Syllables of made-up surnames.
LATIN = "bar bel ben bor cal cor dan del dor fal fen fir gal gar hal han hol jar kel ken lan lar len lor mal mar mel mor nal nor pel per ral ren rol sal sel sol tal tar tel tor val ver vol wal wen wil zan".split()
CYRILLIC = "бар бел бор вал вер гал гор дан дол жар зал зор кал кор лан лар мал мар мел нор пал пер рал род сал сер тал тор фал хол".split()

# Endings of Russian surnames that have a form for women, and that form.
GENDERED = {"ов": "ова", "ев": "ева", "ёв": "ёва", "ин": "ина", "ын": "ына", "ский": "ская", "цкий": "цкая"}

_word = r"\p{Lu}[\p{L}'’-]{1,40}"
_titles = "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES])
_given = "|".join(n for names in GIVEN.values() for n in names)
# Words that begin the next phrase, not a further word of a name.
NOT_NAMES = "The This That These Those A An In On At By Of For From To With And Or But As If When While After Before He She It We They You His Her Its Is Was Has Had Der Die Das Ein Eine Und Er Sie Es Im Am Le La Les Un Une Et Il Elle El Los Las Una Y В И На Он Она Но".split()
_more = rf"(?:[ ](?:\p{{Lu}}\.[ ])?(?!(?:{'|'.join(NOT_NAMES)})(?!\p{{L}})){_word}){{0,4}}"
_first = rf"(?:\p{{Lu}}\.[ ])?{_word}{_more}"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{L}})(?:(?:{_titles})\.?[ ]{_first}|(?:{_given})[ ]{_first})(?![\p{{L}}\p{{N}}])"
# A name's words, the possessive s apart, and what is between them.
NAME_PART = r"['’]s(?!\p{L})|\p{L}(?:[\p{L}-]|['’](?!s(?!\p{L})))*|[^\p{L}'’]+|['’]"
_octet = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_is = r"[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?"
_assigned = rf"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key){_is}"
_value = r"[A-Za-z0-9_+/=~.!#$%^&*@?-]"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
# Behind a password's key any value with a letter or digit, behind the others one with a digit.
ASSIGNED = rf"(?:(?i:password|passwd|pwd){_is}(?={_value}{{0,199}}[A-Za-z0-9])|{_assigned}(?=[A-Za-z_+/=~.!#$%^&*@?-]{{0,199}}[0-9])){_value}{{5,199}}[A-Za-z0-9_+/=~#$%^&*@-]"
KEY = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abps]-[A-Za-z0-9-]{10,72}|(?=[a-f]{0,64}[0-9])[0-9a-f]{32,128})(?![A-Za-z0-9])"
IP = rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?![0-9]|\.[0-9])"
_hex = "[0-9A-Fa-f]{1,4}"
_short6 = "|".join([rf"(?:{_hex}:){{{n}}}(?::{_hex}){{1,{7 - n}}}" for n in range(1, 7)] + [rf":(?::{_hex}){{1,7}}", rf"(?:{_hex}:){{1,7}}:"])
IP6 = rf"(?<![\p{{L}}0-9_:])(?:(?:{_hex}:){{7}}{_hex}|{_short6})(?![\p{{L}}0-9_:])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?|[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{7,15}(?![0-9])"
WITH_MARKS = "|".join([EMAIL, ASSIGNED, KEY, IP, IP6, SOCIAL, IBAN, CARD, PHONE])
ENTITY = f"{WITH_MARKS}|{NAME}"
#: Parts into which the mentions of an entity are dealt.
SALTS = 256
_drawn: dict[str, str] = {}


def run_secret(spark: SparkSession) -> str:
    """The secret that keys surrogates: ``spark.sparkwell.pii.secret`` of the session, or one drawn at random for this application.

    Runs with the same secret give the same surrogates. It is a literal of the plan, so plans and event logs are to be kept like it.
    """
    return spark.conf.get("spark.sparkwell.pii.secret", None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _capitals(x: Column) -> Column:
    return (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)


def _as_name(token: Column) -> Column:
    """A name's word in the case that names have, so that capitals make no other entity."""
    return F.when(_capitals(token), F.initcap(F.lower(token))).otherwise(token)


def _of_woman(token: Column) -> Column:
    return F.lower(token).rlike(rf"^\p{{L}}{{2,}}(?:{'|'.join(GENDERED.values())})$")


def _of_man(token: Column) -> Column:
    """The form for men of a surname that has two, else the word as it is."""
    out = token
    for man, woman in GENDERED.items():
        out = F.when(token.rlike(rf"^\p{{L}}{{2,}}{woman}$"), F.regexp_replace(token, f"{woman}$", man)).otherwise(out)
    return out


def _in_place(kind: Column, text: Column, made: Column) -> Column:
    """A name's surrogate as it stands here: the form for women and capitals, where the original has them."""
    woman = made
    for man, own in GENDERED.items():
        woman = F.when(F.endswith(made, F.lit(man)), F.regexp_replace(made, f"{man}$", own)).otherwise(woman)
    own = F.when((kind == "surname_cyrillic") & _of_woman(text), woman).otherwise(made)
    return F.when(_capitals(text), F.upper(own)).otherwise(own)


def _cyrillic(x: Column) -> Column:
    return x.rlike(r"\p{IsCyrillic}")


def _part(kind: Column | str, key: Column, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key"), text.alias("text"))


def _parts(x: Column) -> Column:
    """An entity's parts in order: kind, key (what is the same wherever it stands for the same thing) and text. Kind ``keep`` stays as it is."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    plain = lambda kind, key: F.array(_part(kind, key, x))
    user, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    head = F.regexp_extract(x, "^" + _assigned, 0)
    value = F.regexp_replace(x, "^" + _assigned, "")
    lists = {kind: F.array(*map(F.lit, names)) for kind, names in GIVEN.items()}

    def name(token: Column) -> Column:
        word = _as_name(token)
        kind = F.when(~token.rlike(r"^\p{L}") | (F.length(token) == 1) | token.isin(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES), "keep")
        for k, names in lists.items():
            kind = kind.when(F.array_contains(names, word), k)
        kind = kind.when(_cyrillic(token), "surname_cyrillic").otherwise("surname_latin")
        return _part(kind, F.when(kind == "surname_cyrillic", _of_man(word)).otherwise(word), token)

    return (
        F.when(head != "", F.array(_part("keep", head, head), _part("secret", value, value)))
        .when(F.contains(x, F.lit("@")), F.array(_part("user", F.lower(x), user), _part("keep", F.lit("@"), F.lit("@")), _part("domain", F.lower(domain), domain)))
        .when(x.rlike("^" + KEY + "$"), plain("secret", x))
        .when(x.rlike(f"^{IP}$"), plain("ip", x))
        .when(x.rlike(f"^{IP6}$"), plain("ip6", F.lower(x)))
        .when(x.rlike("^[A-Z]{2}[0-9]{2}"), plain("iban", F.regexp_replace(x, " ", "")))
        .when(x.rlike(f"^{SOCIAL}$"), plain("social", digits))
        .when(x.rlike(f"^{CARD}$"), plain("card", digits))
        .when(x.rlike("[0-9]"), plain("phone", digits))
        .otherwise(F.transform(F.regexp_extract_all(x, F.lit(NAME_PART), F.lit(0)), name))
    )


def _entity_of(text: Column) -> Column:
    """The pattern of a text's entities: in one with names their words are entities wherever else they stand."""
    names = F.regexp_extract_all(text, F.lit(NAME), F.lit(0))
    words = F.flatten(F.transform(names, lambda x: F.regexp_extract_all(x, F.lit(NAME_PART), F.lit(0))))
    words = F.filter(F.array_distinct(words), lambda w: w.rlike(r"^\p{L}{2}|^\p{L}['’-]\p{L}") & ~w.isin(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES + NOT_NAMES))
    # the same words in capitals, and both forms of a surname that has two
    words = F.flatten(F.transform(words, lambda w: F.array_distinct(F.array(w, _of_man(w), _in_place(F.lit("surname_cyrillic"), F.lit("Иванова"), _of_man(w))))))
    words = F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 2, F.array(w, F.upper(w))).otherwise(F.array(w)))))
    longest_first = F.array_join(F.reverse(F.array_sort(words)), "|")
    return F.when(text.rlike(NAME) & (longest_first != ""), F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), longest_first, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(ENTITY)


def _draw(secret: str, kind: Column, key: Column, draw: Column) -> Column:
    """128 hexadecimal digits that depend on the secret, the part and the number of the draw."""
    seed = F.concat_ws("\u0001", F.lit(secret), kind, key, draw.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\u0002")), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _same_form(text: Column, stream: Column, fixed: Column, hexadecimal: Column) -> Column:
    """A digit for a digit, a letter for a letter of the same case (or among hexadecimal ones); the first ``fixed`` characters and all others stay."""
    pick = lambda i, letters: F.substring(F.lit(letters), F.pmod(_byte(stream, i), F.lit(len(letters))) + 1, F.lit(1))

    def change(c: Column, i: Column) -> Column:
        return (
            F.when(i < fixed, c)
            .when(hexadecimal, pick(i, "0123456789abcdef"))
            .when(c.rlike("[0-9]"), pick(i, "0123456789"))
            .when(c.rlike("[a-z]"), pick(i, "abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick(i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn(digits: Column) -> Column:
    """The sum that a card's digits have modulo 10; 0 for valid ones."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _card(text: Column, stream: Column, wide: Column) -> Column:
    """Same length, grouping and first digit; valid if the original is. ``wide`` are further digits."""
    other = F.concat(_same_form(text, stream, F.lit(1), F.lit(False)), wide)
    head = F.substring(other, F.lit(1), F.length(other) - 1)
    bare = F.regexp_replace(head, "[^0-9]", "")
    check = F.pmod(10 - _luhn(F.concat(bare, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(F.regexp_replace(text, "[^0-9]", "")) == 0, F.concat(head, check)).otherwise(other)


def _remainder(iban: Column) -> Column:
    """What an account number without spaces leaves by 97; 1 for valid ones."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(a: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value < 58, (a * 10 + value - 48) % 97).otherwise((a * 100 + value - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _iban(text: Column, stream: Column, wide: Column) -> Column:
    """Same country and form, without spaces; check digits are right if those of the original are."""
    other = F.regexp_replace(F.concat(_same_form(text, stream, F.lit(2), F.lit(False)), wide), " ", "")
    country, rest = F.substring(other, 1, 2), F.substring(other, F.lit(5), F.length(other))
    check = F.lpad((98 - _remainder(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.when(_remainder(F.regexp_replace(text, " ", "")) == 1, F.concat(country, check, rest)).otherwise(other)


def _surname(syllables: list[str], stream: Column, draw: Column, ending: Column) -> Column:
    """Three syllables, one more with every tenth draw, and the ending."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(draw / 10).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, syllables)), F.pmod(_byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1), F.lit(len(syllables))) + 1))
    return F.concat(F.initcap(F.array_join(parts, "")), ending)


def _given_map(secret: str) -> dict[str, str]:
    """Each name's successor in a keyed order of the names of its script and gender: no two get the same, none itself."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{secret}\u0001{n}".encode()).digest())
        out.update(zip(order, [*order[1:], order[0]], strict=True))
    return out


def _surrogate(secret: str, kind: Column, key: Column, text: Column, draw: Column) -> Column:
    """Every tenth draw widens the form by a digit (a name by a syllable; addresses take the longer form), so that no form is ever used up."""
    stream = _draw(secret, kind, key, draw)
    octet = lambda i: (F.pmod(_byte(stream, F.lit(2 * i)) * 256 + _byte(stream, F.lit(2 * i + 1)), F.lit(254)) + 1).cast("string")
    given = F.create_map(*[F.lit(x) for pair in _given_map(secret).items() for x in pair])
    hexadecimal = (kind == "secret") & text.rlike("^[0-9a-f]{16,}$") & text.rlike("[a-f]")
    more = F.floor(draw / 10).cast("int")
    wide = F.translate(F.substring(stream, F.lit(65), more), "abcdef", "024689")
    letters = F.translate(F.substring(stream, 1, 12), "0123456789", "ghijklmnop")
    fixed = F.when(text.rlike("^(AKIA|ASIA|gh[pousr]_|xox)"), 4).when(text.rlike("^sk-"), 3).when(text.rlike(r"^\+"), F.least(F.length(F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .-])|^\+[0-9]", 0)), F.lit(4))).otherwise(0)
    return (
        F.when(F.startswith(kind, F.lit("given")), F.get(F.map_values(F.map_filter(given, lambda k, _: k == key)), F.lit(0)))
        .when(kind == "surname_latin", _surname(LATIN, stream, draw, F.lit("")))
        .when(kind == "surname_cyrillic", _surname(CYRILLIC, stream, draw, F.regexp_extract(key, f"(?<=\\p{{L}}{{2}})(?:{'|'.join(GENDERED)})$", 0)))
        .when(kind == "domain", F.concat(letters, F.lit(".example.net")))
        .when((kind == "ip") & (more > 0), F.concat_ws(":", F.lit("2001:db8"), *(F.substring(stream, 1 + 4 * k, 4) for k in range(6))))
        .when(kind == "ip", F.concat_ws(".", *(octet(i) for i in range(4))))
        .when(kind == "card", _card(text, stream, wide))
        .when(kind == "iban", _iban(text, stream, wide))
        .when((kind == "ip6") & F.contains(text, F.lit("::")), F.concat_ws(":", F.substring(stream, 1, 4), F.substring(stream, 5, 4), F.lit(""), F.substring(stream, 9, 4), F.substring(stream, 13, 4)))
        .when(kind == "ip6", F.concat(_same_form(text, stream, F.lit(0), F.lit(True)), F.when(more > 0, F.concat(F.lit(":"), wide)).otherwise(F.lit(""))))
        .when(((kind == "user") & (F.length(text) < 8)) | ((kind == "secret") & (F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) < 6)), F.concat(F.substring(letters, 1, 8), _same_form(text, stream, F.lit(0), F.lit(False))))
        .otherwise(F.concat(_same_form(text, stream, fixed, hexadecimal), wide))
    )


def _as_key(kind: Column, made: Column) -> Column:
    """A surrogate as its original's key would be written."""
    numbers = F.regexp_replace(made, "[^0-9]", "")
    return F.when(kind.isin("phone", "card", "social"), numbers).when(kind == "iban", F.regexp_replace(made, " ", "")).when(kind.isin("user", "domain", "ip6"), F.lower(made)).otherwise(made)


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """kind, key and made for distinct entities (kind, key, text), all distinct and none equal to an original.

    Of entities that get the same surrogate the one of fewest draws (then least key) keeps it, the others draw again until
    no two are equal; given names need no check, theirs is a permutation. Draws widen crowded forms, so this ends.
    """
    now = save_table(entities.filter("kind <> 'keep'").withColumn("draw", F.lit(0)).withColumn("made", _surrogate(secret, F.col("kind"), F.col("key"), F.col("text"), F.col("draw"))), "entities")
    checked = ~F.startswith(F.col("kind"), F.lit("given"))
    same = Window.partitionBy("kind", _as_key(F.col("kind"), F.col("made"))).orderBy("draw", "key")
    while True:
        originals = now.select("kind", F.when(F.col("kind") == "user", F.substring_index("key", "@", 1)).otherwise(F.col("key")).alias("_made")).distinct().withColumn("_taken", F.lit(True))
        marked = now.withColumn("_nth", F.row_number().over(same)).withColumn("_made", _as_key(F.col("kind"), F.col("made"))).join(originals, ["kind", "_made"], "left")
        marked = save_table(marked.select("kind", "key", "text", "draw", "made", (checked & ((F.col("_nth") > 1) | F.col("_taken").isNotNull())).alias("again")), "checked")
        if marked.filter("again").isEmpty():
            return marked.select("kind", "key", "made")
        next_ = F.col("draw") + F.col("again").cast("int")
        now = save_table(marked.select("kind", "key", "text", next_.alias("draw"), F.when(F.col("again"), _surrogate(secret, F.col("kind"), F.col("key"), F.col("text"), next_)).otherwise(F.col("made")).alias("made")), "entities")


def pseudonymise(docs: DataFrame, secret: str, count: str | None = None) -> DataFrame:
    """``docs`` with all columns, entities in ``text`` replaced; ``count`` names a column (long) to add with their number.

    Entities: emails, phone numbers, IP addresses, card, bank and social security numbers, keys and passwords, and names with a title
    or a known given name. A part's surrogate depends on the secret and the part alone unless it collides, so it is the same in
    all documents; account numbers keep right check digits, surnames their form for men or women, capitals stay capitals. Further mentions
    of a name's words in the same text are replaced with it, also in capitals and in the other form of a surname. Texts without entities pass through untouched and are not shuffled; null stays null. Repeated rows get
    equal texts, an empty table gives no rows. Matches are bounded in length, so long texts take linear time.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text")
    has = F.coalesce((text.rlike("[0-9@:=]") & text.rlike(WITH_MARKS)) | text.rlike(NAME), F.lit(False))
    hits = docs.filter(has).select(F.struct(*columns).alias("__doc"), text.alias("__text"), _entity_of(text).alias("__entity"))
    hits = hits.select(F.monotonically_increasing_id().alias("__row"), "__doc", F.split("__text", F.col("__entity")).alias("__rest"), F.regexp_extract_all("__text", F.col("__entity"), F.lit(0)).alias("__found"))
    hits = save_table(hits, "hits")
    found = hits.select("__row", F.posexplode("__found").alias("__at", "x"))
    parts = found.select("__row", "__at", F.posexplode(_parts(F.col("x"))).alias("__part", "p")).select("__row", "__at", "__part", "p.*")
    parts = save_table(parts, "parts")
    entities = parts.groupBy("kind", "key").agg(F.min("text").alias("text"))
    made = surrogates(entities, secret)
    # an entity may have any share of the mentions; what stays as it is needs no join
    joined = join_salted(parts.filter("kind <> 'keep'"), made, ["kind", "key"], "__row", SALTS).unionByName(parts.filter("kind = 'keep'").withColumn("made", F.lit(None).cast("string")))
    # a phone number keeps the form in which it stands here, so all but the digits come from this text
    new = F.when(F.col("kind") == "keep", F.col("text")).when(F.col("kind").isin("phone", "card", "social", "iban"), _in_form(F.col("text"), F.col("made"))).when(F.col("kind").rlike("^(given|surname)"), _in_place(F.col("kind"), F.col("text"), F.col("made"))).otherwise(F.col("made"))
    whole = joined.groupBy("__row").agg(F.collect_list(F.struct("__at", "__part", new.alias("new"))).alias("new"))
    rest = F.transform("__rest", lambda x, i: F.struct(i.alias("__at"), F.lit(-1).alias("__part"), x.alias("new")))  # each stands before its entity
    pieces = F.transform(F.array_sort(F.concat(rest, "new")), lambda n: n["new"])
    back = hits.join(whole, "__row")
    fields = [(F.col("__text") if c == "text" else F.col("__doc")[c]).alias(c) for c in docs.columns]
    done = back.withColumn("__text", F.array_join(pieces, "")).select(*fields, *([F.size("__found").cast("long").alias(count)] if count else []))
    clean = docs.filter(~has).select(*columns, *([F.lit(0).cast("long").alias(count)] if count else []))
    return clean.unionByName(done)


def _in_form(text: Column, made: Column) -> Column:
    """The letters and digits of ``made`` in the places of those of ``text``, further ones behind."""
    bare = F.regexp_replace(made, "[^0-9A-Za-z]", "")
    marks = F.transform(F.split(text, ""), lambda c: c.rlike("[0-9A-Za-z]"))
    nth = lambda i: F.size(F.filter(F.slice(marks, F.lit(1), i + 1), lambda m: m))
    placed = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(bare, nth(i), F.lit(1))).otherwise(c)), "")
    return F.concat(placed, F.substring(bare, F.size(F.filter(marks, lambda m: m)) + 1, F.length(bare)))
