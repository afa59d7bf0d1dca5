"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"

# Category labels and their rule words.
CATEGORY_RULES = {
    "decision": "decision decide decided choose chosen tradeoff because therefore",
    "task": "task todo action next must should implement build fix verify deadline",
    "research": "research evidence study source finding observed analysis hypothesis",
    "error": "error failure failed exception bug issue risk problem blocked",
    "tool": "tool command api endpoint script adapter integration function module",
    "event": "event happened meeting call update status timeline milestone",
    "concept": "concept definition means architecture design pattern model system",
}

# Labels of technical memories and their patterns, case ignored.
TECHNICAL_RULES = {
    "architecture": r"\b(architecture|architectural|design|module|adapter|genserver|ets|service|dependency|elixir-native|native architecture)\b",
    "decision": r"\b(decision|decided|choose|chosen|will use|use .* instead|adr|accepted)\b",
    "bug": r"\b(bug|failure|fails?|error|flaky|broken|regression|crash|exception|defect)\b",
    "api_contract": r"\b(api|contract|schema|endpoint|callback|interface|public type|wire shape)\b",
    "constraint": r"\b(constraint|must|must not|cannot|can't|should|should not|requirement|compatibility)\b",
    "todo": r"\b(todo|fix|implement|follow[- ]?up|next step|task)\b",
    "preference": r"\b(prefers?|preference|avoid|likes?|wants?|favor|favour)\b",
    "project_state": r"\b(blocked by|status|current state|moving toward|moving away|direction|roadmap|deprecated)\b",
}
TECHNICAL_PRIORITY = ((("decision", "bug", "api_contract"), 1.8), (("architecture", "constraint", "todo"), 1.6), (("preference", "project_state"), 1.4))

# Attributes of fact claims, in the order in which they are tried.
FACT_ATTRIBUTES = ("email", "phone", "age", "status", "birthday", "deadline", "owner")

# Statement patterns by type, with the prefix of the statement.
CLAIM_PATTERNS = (
    ("preference", r"\b(?:the\s+)?user\s+prefers?\s+([^.;\n]+)", "user prefers "),
    ("preference", r"\bprefer\s+([^.;\n]+)", "prefer "),
    ("preference", r"\bavoid\s+([^.;\n]+)", "avoid "),
    ("decision", r"\bdecided\s+to\s+([^.;\n]+)", "decided to "),
    ("decision", r"\bdecision\s+(?:is|was)\s+to\s+([^.;\n]+)", "decision is to "),
    ("decision", r"\bwill\s+use\s+([^.;\n]+)", "will use "),
    ("pattern", r"\b(?:this\s+agent|agent|system|it)\s+often\s+([^.;\n]+)", "agent often "),
    ("pattern", r"\b(?:this\s+agent|agent|system|it)\s+usually\s+([^.;\n]+)", "agent usually "),
    ("pattern", r"\b(?:this\s+agent|agent|system|it)\s+keeps\s+([^.;\n]+)", "agent keeps "),
    ("pattern", r"\bkeeps\s+failing\s+because\s+([^.;\n]+)", "keeps failing because "),
    ("project_state", r"\bproject\s+direction\s+is\s+([^.;\n]+)", "project direction is "),
    ("project_state", r"\bmoving\s+((?:toward|towards|away\s+from)\s+[^.;\n]+)", "moving "),
    ("project_state", r"\bblocked\s+by\s+([^.;\n]+)", "blocked by "),
    ("project_state", r"\bcurrent\s+status\s+(?:is|:)\s+([^.;\n]+)", "current status is "),
)
CLAIM_CONFIDENCE = {"decision": 0.78, "project_state": 0.74, "preference": 0.72, "pattern": 0.68}

# Verbs of actor-verb-object events.
EVENT_VERBS = ("called", "completed", "did", "bought", "paid", "met", "visited", "emailed", "sent", "received", "fixed", "implemented")
EVENT_VERBS_IT = ("chiamato", "completato", "fatto", "comprato", "pagato", "incontrato", "visitato", "inviato", "ricevuto", "sistemato", "implementato")

# Capitalised words that are no entities.
STOP_ENTITIES = "A An And At Category Date Email Entity Event I Il La Le Les Los On The Time Value".split()

# Month names in Italian, Spanish and French.
MONTHS = (
    ("gennaio", "enero", "janvier"),
    ("febbraio", "febrero", "février", "fevrier"),
    ("marzo", "mars"),
    ("aprile", "abril", "avril"),
    ("maggio", "mayo", "mai"),
    ("giugno", "junio", "juin"),
    ("luglio", "julio", "juillet"),
    ("agosto", "août", "aout"),
    ("settembre", "septiembre", "septembre"),
    ("ottobre", "octubre", "octobre"),
    ("novembre", "noviembre"),
    ("dicembre", "diciembre", "décembre", "decembre"),
)

# Patterns of names, addresses, numbers, dates, ages and kinds.
NAME = r"\p{Lu}[\p{L}\p{N}_'-]*"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?U)(?<![\w@])(?:\+\d{1,3}[\s.-]?)?(?:\d[\s.-]?){6,}\d(?![\w@])"
NUMBER = r"(?U)(?<![\w@])\d+(?:[.,]\d+)?(?![\w@])"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
AGE = r"(?U)\b(\p{Lu}[\p{L}\p{N}_'-]*)\b.{0,24}\b(?i:is|age|aged|ha|tiene|età|eta|edad|âge)\s+(?i:is\s+)?(\d{1,3})\b"
CODE_WORDS = r"\b(defmodule|def |defp |function|class|import|const|let|var)\b"
CODE_END = r"[{};]\s*$"
TASK_WORDS = r"(?i)\b(todo|task|action item|next step|implement|verify)\b"
CHAT_ROLES = r"(?i)\b(user|assistant|system):"

# Small talk that a code agent's mission drops.
SMALL_TALK = (*"hi hello hey thanks ok okay cool great nice awesome lol haha yep yes no sure roger".split(), "thank you", "sounds good", "got it")

# What a cue holds that asks for a time, an action or a value.
ASKS_WHEN = ("when", "quando", "cuándo", "quand", "wann")
ASKS_ACTION = ("what", "did", "do", "cosa", "che", "quoi", "que", "qué")
ASKS_VALUE = ("number", "phone", "telephone", "mobile", "age", "numero", "número", "telefono", "teléfono", "età", "eta", "edad", "âge")

# Keys of structured inputs by role, and the relations that a graph may hold.
ENTITY_KEYS = ("name", "person", "entity", "actor")
TIME_KEYS = ("date", "time", "when", "inserted_at")
VALUE_KEYS = ("age", "count", "amount", "number")
PHONE_KEYS = ("phone", "telephone", "mobile")
RELATIONS = ("actor", "acted_on", "happened_at", "has_value", "mentions_entity", "observed_in", "same_entity", "related_to")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: a one-element array binds it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def terms(text: Column, least: int = 2) -> Column:
    """Lower-cased words of at least ``least`` characters, repeats kept."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda x: F.length(x) >= least)


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct terms, in the order of their first use."""
    return F.array_distinct(terms(text, least))


def ascii_terms(text: Column) -> Column:
    """Distinct terms of at least three ASCII letters, digits or underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: F.length(x) >= 3))


def entities(text: Column) -> Column:
    """Distinct words of two characters or more that begin with a capital letter."""
    return F.array_distinct(F.filter(F.split(text, WORD_BREAK), lambda x: x.rlike(r"^\p{Lu}[\p{L}\p{N}_]+$")))


def ascii_entities(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z0-9_]+\b"), F.lit(0)))


def named_entities(text: Column) -> Column:
    """Distinct capitalised names, without the stop list."""
    return F.array_distinct(names(text))


def names(text: Column) -> Column:
    """Capitalised names in order, repeats kept, without the stop list."""
    stop = F.array(*[F.lit(x) for x in STOP_ENTITIES])
    return F.filter(F.regexp_extract_all(text, F.lit(rf"\b{NAME}\b"), F.lit(0)), lambda x: ~F.array_contains(stop, x))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))


def summary(text: Column, most: int = 36) -> Column:
    return F.array_join(F.slice(words(text), 1, most), " ")


def key_points(text: Column, most: int = 3) -> Column:
    """The first sentences, cut behind full stops, exclamation and question marks."""
    return F.slice(F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != ""), 1, most)


def categories(text: Column) -> Column:
    """Labels whose rule words occur in the text, in the order of the rules."""
    rule = lambda own, v: F.arrays_overlap(own, F.array(*[F.lit(w) for w in v.split()]))
    labels = lambda own: F.array(*[F.when(rule(own, v), F.lit(k)) for k, v in CATEGORY_RULES.items()])
    return F.array_compact(bound(F.transform(words(text), F.lower), labels))


def chunk_categories(text: Column) -> Column:
    return bound(categories(text), lambda found: F.when(F.size(found) == 0, F.array(F.lit("note"))).otherwise(found))


def technical_categories(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(k)) for k, p in TECHNICAL_RULES.items()]))


def technical_priority(labels: Column) -> Column:
    out = None
    for names, value in TECHNICAL_PRIORITY:
        test = F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.when(F.size(labels) > 0, F.lit(1.2)).otherwise(F.lit(1.0))


def kind(text: Column) -> Column:
    """text, code, task, chat or prompt, by the first test that holds."""
    t = F.trim(text)
    return (
        F.when((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]")), F.lit("text"))
        .when(t.rlike(CODE_WORDS) | t.rlike(CODE_END), F.lit("code"))
        .when(t.rlike(TASK_WORDS), F.lit("task"))
        .when(t.rlike(CHAT_ROLES), F.lit("chat"))
        .when(F.lower(t).contains("prompt"), F.lit("prompt"))
        .otherwise(F.lit("text"))
    )


def stream_of(kind_: Column) -> Column:
    return F.when(kind_ == "task", "planning").when(kind_.isin("chat", "prompt"), "chat").when(kind_ == "code", "code_learning").otherwise("memory")


def title(text: Column, kind_: Column) -> Column:
    """The first line that is not blank, cut at 90 characters."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\x0B\f\r]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(90)), F.concat(kind_, F.lit(" memory")))


def token_estimate(text: Column) -> Column:
    """Four thirds of the words, at least 1."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.greatest(F.lit(1), F.floor(n * 4 / 3)).cast("long")


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def fact_claim(text: Column) -> Column:
    """struct(subject, attribute, value) of the first attribute that the text states, or null."""
    tries = []
    for a in FACT_ATTRIBUTES:
        p = rf"(?i)\b([\p{{L}}\p{{N}}_'-]+)\s+{a}\s+(?:is|=|:)\s+([^;\n]+)"
        subject, value = normal(F.regexp_extract(text, p, 1)), normal(F.regexp_replace(F.regexp_extract(text, p, 2), r"\.+$", ""))
        tries.append(F.when((subject != "") & (value != ""), F.struct(subject.alias("subject"), F.lit(a).alias("attribute"), value.alias("value"))))
    return F.coalesce(*tries)


def normal_statement(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"\.+$", ""), r"\s+", " "))


def claims(text: Column) -> Column:
    """array of struct(type, statement, confidence); repeats and statements inside longer ones of their type are dropped."""

    def claim(kind_: str, head: str):
        return lambda x: F.struct(F.lit(kind_).alias("type"), normal_statement(F.concat(F.lit(head), F.trim(x))).alias("statement"), F.lit(CLAIM_CONFIDENCE[kind_]).alias("confidence"))

    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)), claim(t, head)) for t, p, head in CLAIM_PATTERNS]))
    bound = F.transform(F.array(F.array_distinct(found)), lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda o: (o["type"] == c["type"]) & (o["statement"] != c["statement"]) & F.contains(o["statement"], c["statement"]))))
    return F.get(bound, F.lit(0))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def ages(text: Column) -> Column:
    """array of struct(name, age) that the text states."""
    parts = [F.regexp_extract_all(text, F.lit(AGE), F.lit(i)) for i in (1, 2)]
    return F.arrays_zip(parts[0].alias("name"), parts[1].alias("age"))


def plain_numbers(text: Column) -> Column:
    """Numbers that are no part of a phone number, an age or a date."""
    taken = F.concat(phones(text), F.flatten(F.transform(phones(text), numbers)), F.transform(ages(text), lambda a: a["age"]))
    dated = lambda x: F.contains(text, F.concat(x, F.lit("-"))) | F.contains(text, F.concat(F.lit("-"), x)) | F.regexp_like(text, F.concat(F.lit(r"\b"), F.replace(x, F.lit("."), F.lit(r"\.")), F.lit(r"\s+\p{L}+\s+\d{4}\b")))
    return bound(taken, lambda out: F.filter(numbers(text), lambda x: ~F.array_contains(out, x) & ~dated(x)))


def phone_display(phone: Column, mode: str = "classify") -> Column:
    """How a phone number is shown: redacted, or as it is with mode raw."""
    return phone if mode == "raw" else F.lit("[redacted phone]")


def nearby_name(text: Column, at: Column) -> Column:
    """The last name in the 40 characters before the first place of ``at``."""
    before = F.right(F.call_function("substring_index", text, at, F.lit(1)), F.lit(40))
    return bound(names(before), lambda found: F.get(found, F.size(found) - 1))


def iso_dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(0))


def month_dates(text: Column) -> Column:
    """Dates with a month's name as yyyy-mm-dd; impossible dates are dropped."""
    names = [n for group in MONTHS for n in group]
    p = rf"(?iu)\b(\d{{1,2}})\s+({'|'.join(sorted(names, key=len, reverse=True))})\s+(\d{{4}})\b"
    number = F.create_map(*[F.lit(x) for i, group in enumerate(MONTHS) for n in group for x in (n, f"{i + 1:02d}")])
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))

    def iso(x: Column) -> Column:
        parts = F.split(F.lower(x), r"\s+")
        return F.try_to_date(F.concat_ws("-", parts[2], number[parts[1]], F.lpad(parts[0], 2, "0")), "yyyy-MM-dd").cast("string")

    return F.array_compact(F.transform(found, iso))


def events(text: Column) -> Column:
    """array of struct(actor, action, object) from actor-verb-object phrases."""
    name = NAME

    def scan(pattern: str) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
        return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("actor", "action", "object"), strict=True)]), lambda x: F.struct(x["actor"].alias("actor"), x["action"].alias("action"), x["object"].alias("object")))

    return F.concat(scan(rf"\b({name})\s+({'|'.join(EVENT_VERBS)})\s+({name})?"), scan(rf"\b({name})\s+(?:ha\s+)?({'|'.join(EVENT_VERBS_IT)})\s+({name})?"))


def simhash(text: Column, bits: int = 32) -> Column:
    """A fingerprint of ASCII words of three characters or more; every occurrence votes, ties set the bit."""
    half, one, none = bits // 2, F.lit(1).cast("long"), F.lit(0).cast("long")
    tokens = bound(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: F.length(x) >= 3), lambda own: F.when(F.size(own) == 0, F.array(text)).otherwise(own))
    hashes = F.transform(tokens, lambda x: F.conv(F.left(F.md5(x), F.lit(8)), 16, 10).cast("long"))
    # A long counts two bits, the upper half's in its upper 32 bits: a text has fewer words than that holds.
    pairs = F.transform(hashes, lambda h: F.shiftleft(F.shiftright(h, half), 32).bitwiseOR(h.bitwiseAND((1 << half) - 1)))

    def vote(own: Column, i: int) -> Column:
        n = F.size(own)
        bit = lambda yes, at: F.when(2 * yes >= n, F.shiftleft(one, at)).otherwise(none)
        counts = F.aggregate(own, none, lambda a, h: a + F.shiftright(h, i).bitwiseAND((1 << 32) + 1))
        return bound(counts, lambda c: bit(c.bitwiseAND((1 << 32) - 1), i) + bit(F.shiftright(c, 32), i + half))

    def votes(own: Column) -> Column:
        total = none
        for i in range(half):
            total = total + vote(own, i)
        return total

    return bound(pairs, votes)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chunks(text: Column, size: int = 180, overlap: int = 40) -> Column:
    """array of struct(start, words) of overlapping word windows; windows go on until words run out."""
    window = lambda own: lambda i: F.struct(i.alias("start"), F.slice(own, i + 1, F.lit(size)).alias("words"))
    cut = lambda own: F.when(F.size(own) == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.size(own) - 1, F.lit(size - overlap)), window(own)))
    return bound(words(text), cut)


def small_talk(text: Column) -> Column:
    """Whether a text is small talk and nothing else."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[.!?]+$", "").isin(*SMALL_TALK)


def small_talk(text: Column) -> Column:
    """Whether a text is small talk and nothing else; full stops, then exclamation and question marks at its end don't count."""
    return F.lower(F.regexp_replace(F.trim(text), r"\.*!*\?*$", "")).isin(*SMALL_TALK)


def asks(cue: str, words_: tuple[str, ...]) -> bool:
    """Whether a cue holds one of some words, anywhere."""
    return any(w in cue.lower() for w in words_)


def flat_pairs(json: Column, depth: int = 3) -> Column:
    """Key-value pairs of a JSON object, those of nested objects in place of the objects; keys in lower case."""
    entries = F.coalesce(F.map_entries(F.from_json(json, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))
    plain = lambda e: F.array(F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    if depth <= 1:
        return F.flatten(F.transform(entries, plain))
    return F.flatten(F.transform(entries, lambda e: F.when(F.startswith(e["value"], F.lit("{")), flat_pairs(e["value"], depth - 1)).otherwise(plain(e))))


def secret_label(label: str | None) -> str:
    return (label or "").strip() or "secret"


def redacted(label: str | None) -> str:
    """What stays readable of a secret."""
    return f"secret: {secret_label(label)}"
