"""Prompt grammar, scenes, slugs and other text rules, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of prompts in the order in which they are tried, each with its kind and the groups of direction and
#: reference (fixed values; the target is the first group).
PROMPTS = (
    (r"^Give (?:the )?(.+?) to me$", "give", 0, 0),
    (r"^Give me (?:the )?(.+?)$", "give", 0, 0),
    (r"^Pick up (?:the )?(.+?) to the (left|right) of (?:the )?(.+?)$", "relative", 2, 3),
    (r"^Pick up (?:the )?(.+?) on the (left|right) of (?:the )?(.+?)$", "relative", 2, 3),
    (r"^Pick up (?:the )?(.+?) on the (left|right)$", "absolute", 2, 0),
    (r"^Pick up (?:the )?(.+?) to the (left|right)$", "absolute", 2, 0),
    (r"^Pick up (?:the )?(.+?)$", "single", 0, 0),
)
#: Objects of the closed vocabulary, aliases of theirs, and other names of one object (fixed values).
OBJECTS = ("yellow duck", "brown dog", "orange lion", "green dinosaur")
ALIASES = {"dinosaur": "green dinosaur", "dinasour": "green dinosaur", "green dinasour": "green dinosaur"}
SYNONYMS = {"brown dog": ("dog", "grey dog", "gray dog", "beige bear", "light brown bear", "brown bear")}
#: Words of scenes, directions, and words that are no object (fixed values).
GIVE = ("give", "hand over", "pass", "递给", "交给")
PICK = ("pick", "grasp", "take", "拿", "抓", "取")
PLACE = ("place", "put", "insert", "drop", "放", "放置")
DIRECTIONS = ("left", "right", "front", "back", "behind", "near", "next", "beside", "between", "under", "above", "top", "bottom", "左", "右", "前", "后", "旁边", "附近", "上", "下")
ANCHORS = ("pick", "grasp", "take", "place", "put", "give", "拿", "抓", "取", "放")
STOPWORDS = (
    "a", "an", "and", "at", "back", "behind", "beside", "between", "blue", "bottom", "front", "from", "give", "green", "hand", "into", "left", "near", "next", "me",
    "object", "of", "on", "onto", "pick", "place", "put", "red", "right", "take", "the", "to", "top", "up", "white", "with", "yellow",
)
#: Beginnings and ends of a task that are no part of its object, as they are tried (fixed values).
TASK_STARTS = tuple(f"{verb} {article}" for verb in ("pick up", "pick", "place", "put", "put down", "grasp", "grab", "give", "hand over", "hand", "move", "lift") for article in ("the ", ""))
TASK_ENDS = (" to the person", " to person", " to me", " to the table", " to the box")
#: Texts of the stages of each family of tasks, with the words that show it, as they are tried (fixed values).
STAGE_FAMILIES = (
    (("give", "hand"), ("prepare to grasp {object}", "reach for {object}", "grasp {object}", "lift {object}{end}", "release {object} to hand", "give complete")),
    (("pick", "grasp", "grab", "lift"), ("prepare to grasp {object}", "reach for {object}", "grasp {object}", "lift {object}", "pick complete")),
    (("place", "put"), ("prepare to place object", "move object to target area", "place object", "retreat gripper", "place complete")),
    ((), ("prepare for {task}", "approach target for {task}", "execute {task}", "retreat from {task}", "{task} complete")),
)
#: Answers that name nothing; those that leave it open too; those that are unclear too (fixed values).
NOTHING = ("", "null", "none", "n/a")
OPEN = (*NOTHING, "unknown")
UNCLEAR = (*OPEN, "unclear")
#: Forms of canonical prompts as they are tried, {o} being any object: scene, whether it is the canonical wording, and the
#: canonical text with the groups of target, side and reference in it (fixed values).
CANONICAL = (
    (r"^give the {o} to me$", "give", True, ("Give the ", 1, " to me")),
    (r"^pick up the {o} to the (left|right) of the {o}$", "relational_pick", True, ("Pick up the ", 1, " to the ", 2, " of the ", 3)),
    (r"^pick up the {o} on the (left|right) of the {o}$", "relational_pick", False, ("Pick up the ", 1, " to the ", 2, " of the ", 3)),
    (r"^pick up the {o} on the (left|right)$", "directional_pick", True, ("Pick up the ", 1, " on the ", 2)),
    (r"^pick up the {o}$", "pick", True, ("Pick up the ", 1)),
    (r"^(?:place|put)(?: the)? object$", "place", True, ("Place object",)),
)
#: Forms in which a target can be put into a prompt: what stands before it, the target, what follows, a full stop (fixed values).
TARGETED = (
    r"(?i)^(Give\s+(?:the\s+)?)(.+?)(\s+to\s+me)(\.?)$",
    r"(?i)^(Give\s+me\s+(?:the\s+)?)(.+?)()(\.?)$",
    r"(?i)^(Pick\s+up\s+(?:the\s+)?)(.+?)(\s+(?:to|on)\s+the\s+(?:left|right)\s+of\s+(?:the\s+)?.+?)(\.?)$",
    r"(?i)^(Pick\s+up\s+(?:the\s+)?)(.+?)(\s+(?:on|to)\s+the\s+(?:left|right))(\.?)$",
    r"(?i)^(Pick\s+up\s+(?:the\s+)?)(.+?)()(\.?)$",
)
#: Names of backgrounds and what they count as (fixed values).
BACKGROUNDS = {
    "round_table": ("round_table", "round", "circular_table", "circle_table", "圆桌"),
    "square_table": ("square_table", "square", "方桌", "long_table", "rectangular_table", "rectangle_table", "dining_table", "长桌"),
    "tv_cabinet": ("tv_cabinet", "tv_stand", "television_cabinet", "media_console", "电视柜"),
    "sofa": ("sofa", "couch", "沙发"),
}
#: Answers that say match or mismatch, and what a longer answer is read by (fixed values).
SAME = ("match", "matched", "correct", "yes", "true", "consistent", "same")
OTHER = ("mismatch", "mismatched", "incorrect", "wrong", "no", "false", "inconsistent", "different")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def any_of(text: Column, words) -> Column:
    """Whether any of the words stands in the text."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def one_of(text: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair)), text)


def _typos(text: Column) -> Column:
    return F.replace(text, F.lit("dinasour"), F.lit("dinosaur"))


def parse_prompt(text: Column) -> dict[str, Column]:
    """Kind, action, target, direction, reference of the first pattern that the prompt matches, final full stops aside; nulls if none does.

    Target and reference keep their case, typos in them are mended; only prompts that give something have an action.
    """
    clean = F.regexp_replace(stripped(text), r"\.+$", "")

    def first(pick) -> Column:
        out = None
        for pattern, kind, *groups in PROMPTS:
            value, match = pick("(?i)" + pattern, kind, *groups), clean.rlike("(?i)" + pattern)
            out = F.when(match, value) if out is None else out.when(match, value)
        return out

    nothing = F.lit(None).cast("string")
    named = lambda pattern, k: _typos(stripped(F.regexp_extract(clean, pattern, k))) if k else nothing
    return {
        "kind": first(lambda p, kind, d, r: F.lit(kind)),
        "action": first(lambda p, kind, d, r: F.lit("give") if kind == "give" else nothing),
        "target": first(lambda p, kind, d, r: named(p, 1)),
        "direction": first(lambda p, kind, d, r: F.lower(F.regexp_extract(clean, p, d)) if d else nothing),
        "reference": first(lambda p, kind, d, r: named(p, r)),
    }


def canonical_task(text: Column, objects: tuple[str, ...] = OBJECTS) -> dict[str, Column]:
    """Canonical, scene, target, reference, side, task of a prompt that a closed vocabulary makes up in full; 'unknown' otherwise."""
    clean = _typos(F.regexp_replace(F.lower(stripped(F.coalesce(text, F.lit("")))), r"\s+", " "))
    names = "(" + "|".join(re.escape(o) for o in sorted(objects, key=len, reverse=True)) + ")"
    forms = [(pattern.replace("{o}", names), *rest) for pattern, *rest in CANONICAL]

    def first(pick_, other: Column) -> Column:
        out = None
        for pattern, scene_, exact, words in forms:
            value = pick_(pattern, scene_, exact, words)
            out = F.when(clean.rlike(pattern), value) if out is None else out.when(clean.rlike(pattern), value)
        return out.otherwise(other)

    unknown, nothing = F.lit("unknown"), F.lit(None).cast("string")
    part = lambda k, other: first(lambda p, s_, e, words: F.regexp_extract(clean, p, k) if k in words else other, other)
    return {
        "canonical": first(lambda p, s_, e, words: F.lit(e), F.lit(False)),
        "scene": first(lambda p, s_, e, words: F.lit(s_), unknown),
        "target": part(1, unknown),
        "side": part(2, nothing),
        "reference": part(3, nothing),
        "task": first(lambda p, s_, e, words: F.concat(*(F.regexp_extract(clean, p, w) if isinstance(w, int) else F.lit(w) for w in words)), unknown),
    }


def scene(text: Column) -> Column:
    """The scene of a canonical prompt, else by the words in it; 'unknown' if none tells."""
    known, low = canonical_task(text)["scene"], F.lower(F.coalesce(text, F.lit("")))
    picks = any_of(low, PICK)
    words = F.when(any_of(low, GIVE), "give").when(picks & any_of(low, DIRECTIONS), "directional_pick").when(picks, "pick").when(any_of(low, PLACE), "place")
    return F.when(known != "unknown", known).otherwise(words.otherwise("unknown"))


def known_object(text: Column) -> Column:
    """The first object of the vocabulary, or the first alias, that stands in a text."""
    clean = _typos(F.regexp_replace(F.lower(stripped(F.coalesce(text, F.lit("")))), r"[\s_./:-]+", " "))
    out = None
    for word, name in [*((o, o) for o in OBJECTS), *ALIASES.items()]:
        out = F.when(clean.contains(word), name) if out is None else out.when(clean.contains(word), name)
    return out


def label_slug(name: str) -> str:
    """X06 for the name of a column."""
    return re.sub(r"_+", "_", re.sub(r"[\s./:-]+", "_", name.strip().lower())).strip("_") or "unknown"


def object_of_columns(columns: list[str]) -> str | None:
    """The one object that columns of existence labels are about, if they are about one."""

    def known(name: str) -> str | None:
        clean = re.sub(r"[\s_./:-]+", " ", name.strip().lower()).replace("dinasour", "dinosaur")
        return next((o for o in OBJECTS if o in clean), next((o for a, o in ALIASES.items() if a in clean), None))

    objects = {known(c) for c in columns} - {None}
    if objects:
        return objects.pop() if len(objects) == 1 else None
    rest = set()
    for name in columns:
        bare = name.lower()
        for word in ("exists?", "exist_label", "is"):
            bare = re.sub(rf"(^|_){word}(_|$)", "_", bare)
        rest.add(label_slug(bare))
    rest.discard("unknown")
    return rest.pop() if len(rest) == 1 else None


def target_object(text: Column, columns: list[str] | None = None) -> Column:
    """The target of a canonical prompt; else a known object; else that of the existence columns; else two words after a verb that can be a name."""
    canonical = canonical_task(text)["target"]
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\-\x{4e00}-\x{9fff} ]+", " "), r"\s+"), lambda w: w != "")
    verb = F.array_min(F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*ANCHORS)), lambda x: x["i"]))
    rest = F.slice(words, F.coalesce(verb + 2, F.lit(1)), F.greatest(F.size(words), F.lit(1)))
    names = F.slice(F.filter(rest, lambda w: ~w.isin(*STOPWORDS, *DIRECTIONS) & ~w.rlike("^[0-9]+$")), 1, 2)
    free = F.when(F.size(names) > 0, slug(F.array_join(names, " "))).otherwise("unknown")
    return F.coalesce(F.when(canonical != "unknown", canonical), known_object(text), F.lit(object_of_columns(columns or [])), free)


def object_name(text: Column) -> Column:
    """An object's name in lower case with single spaces, synonyms as their first name; null for none, null, n/a and nothing."""
    clean = F.regexp_replace(F.lower(stripped(text)), r"\s+", " ")
    names = {alias: name for name, aliases in SYNONYMS.items() for alias in (name, *aliases)}
    return F.when(clean.isin(*NOTHING), None).otherwise(F.coalesce(one_of(clean, names), clean))


def slug(text: Column) -> Column:
    """Lower case, separators to single underscores, none at the ends; 'unknown' for nothing."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[\s./:-]+", "_"), "_+", "_")
    cut = F.regexp_replace(joined, "^_+|_+$", "")
    return F.when(cut == "", "unknown").otherwise(F.coalesce(cut, F.lit("unknown")))


def rewrite(text: Column, pattern: str, replacement: str) -> dict[str, Column]:
    """The new text, how many places changed, and whether any did."""
    return {"rewritten": F.regexp_replace(text, pattern, replacement), "replacements": F.regexp_count(text, F.lit(pattern)).cast("long"), "changed": text.rlike(pattern)}


def fix_prepositions(text: Column) -> dict[str, Column]:
    """X08: 'pick up the X on the left of the Y' becomes 'to the left of', 'pick up the X to the left' of nothing 'on the left'; and how many places changed."""
    relative = r"(?i)\bpick up the (.+?) on the (left|right) of the (.+?)\b"
    absolute = r"(?i)\bpick up the (.+?) to the (left|right)\b(?!\s+of\b)"
    once = F.regexp_replace(text, relative, "pick up the $1 to the $2 of the $3")
    return {"fixed": F.regexp_replace(once, absolute, "pick up the $1 on the $2"), "changes": (F.regexp_count(text, F.lit(relative)) + F.regexp_count(once, F.lit(absolute))).cast("long")}


def match_case(word: Column, like: Column) -> Column:
    """A word in lower case, but in the case of another: all upper, each word capitalised, or the first letter alone."""
    word, like = F.lower(stripped(F.coalesce(word, F.lit("")))), stripped(F.coalesce(like, F.lit("")))
    capital = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
    titled = F.array_join(F.transform(F.regexp_extract_all(word, F.lit("([a-z]+|[^a-z]+)"), F.lit(1)), capital), "")
    upper = like.rlike("[A-Z]") & ~like.rlike("[a-z]")
    title = like.rlike("[A-Za-z]") & ~like.rlike("(^|[^A-Za-z])[a-z]") & ~like.rlike("[A-Za-z][A-Z]")
    return F.when(upper, F.upper(word)).when(title, titled).when(like.rlike("^[A-Z]") & ~F.substring(like, 2, 1 << 30).rlike("[A-Z]"), capital(word)).otherwise(word)


def prompt_with_target(template: Column, target: Column) -> Column:
    """A prompt with another target in the case of its own; empty if it does not parse, without a target, or if the target is its reference."""
    parsed, name = parse_prompt(template), F.lower(stripped(F.coalesce(target, F.lit(""))))
    clean = stripped(template)
    out = None
    for pattern in TARGETED:
        group = lambda n, p=pattern: F.regexp_extract(clean, p, n)
        value = F.concat(group(1), match_case(name, group(2)), group(3), group(4))
        out = F.when(clean.rlike(pattern), value) if out is None else out.when(clean.rlike(pattern), value)
    useless = parsed["kind"].isNull() | (name == "") | F.coalesce(F.lower(parsed["reference"]) == name, F.lit(False))
    return F.when(useless, "").otherwise(out)


def prompt(action: Column, target: Column, direction: Column, reference: Column) -> Column:
    """X11: the prompt of a scenario."""
    give = F.concat(F.lit("Give me the "), target)
    where = F.when(direction.isNull(), "").when(reference.isNull(), F.concat(F.lit(" on the "), direction)).otherwise(F.concat(F.lit(" to the "), direction, F.lit(" of the "), reference))
    return F.when(action == "give", give).otherwise(F.concat(F.lit("Pick up the "), target, where))


def scenario(kind: Column) -> Column:
    """Give, pick, pick_absolute or pick_relative for a kind of prompt; null without one."""
    return one_of(kind, {"give": "give", "single": "pick", "absolute": "pick_absolute", "relative": "pick_relative"})


def stage_text(task: Column, stage: Column, override: list[str] | None = None) -> Column:
    """What is done in a stage of a task, by the family of its verb; stages beyond the last count as the last, those below as the first; -1: not found."""
    low, n = F.lower(task), stage.cast("int")
    name = stripped(low)
    cut = None
    for word in TASK_STARTS:
        value = F.substring(name, len(word) + 1, 1 << 30)
        cut = F.when(name.startswith(word), value) if cut is None else cut.when(name.startswith(word), value)
    name = cut.otherwise(name)
    end = None
    for word in TASK_ENDS:
        end = F.when(name.endswith(word), word) if end is None else end.when(name.endswith(word), word)
    end = end.otherwise("")
    name = F.left(name, F.length(name) - F.length(end))
    out = None
    for words, texts in STAGE_FAMILIES:
        text = F.get(F.array(*(F.lit(t) for t in texts)), F.greatest(F.lit(0), F.least(F.lit(len(texts) - 1), n)))
        text = F.replace(F.replace(F.replace(text, F.lit("{object}"), name), F.lit("{end}"), end), F.lit("{task}"), low)
        out = F.when(any_of(low, words), text) if out is None else out.when(any_of(low, words), text) if words else out.otherwise(text)
    if override:
        out = F.when(n.between(0, len(override) - 1), F.get(F.array(*(F.lit(t) for t in override)), n)).otherwise(out)
    return F.when(n == -1, F.concat(name, F.lit(" not found"))).otherwise(out)


def several_sentences(text: Column) -> Column:
    """X15."""
    return text.rlike("[,.]")


#: Words for counts (fixed values).
COUNTS = {"zero": 0, "none": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def count_text(text: Column) -> Column:
    """The first word for a count (in their order) that stands in a text, else its first number."""
    low, out = F.lower(stripped(text)), None
    for word, n in COUNTS.items():
        hit = low.rlike(rf"\b{word}\b")
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(F.nullif(F.regexp_extract(low, r"(\d+)", 1), F.lit("")).try_cast("long")).cast("long")


def colour(text: Column) -> Column:
    """A colour in lower case with single spaces, at most 64 characters; null for nothing and for unclear ones."""
    clean = F.regexp_replace(F.lower(stripped(text)), r"\s+", " ")
    return F.when(~clean.isin(*UNCLEAR), F.substring(clean, 1, 64))


def count_bucket(n: Column) -> Column:
    """A count as 0, 1, 2, 3, 4_plus or unknown."""
    return F.when(n.isNull(), "unknown").when(n <= 0, "0").when(n <= 3, n.cast("string")).otherwise("4_plus")


def _key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def background(text: Column) -> Column:
    """The background that a name stands for, else the name as a key; null for nothing and for unclear ones."""
    clean, names = F.lower(stripped(text)), {alias: name for name, aliases in BACKGROUNDS.items() for alias in aliases}
    return F.when(~clean.isin(*UNCLEAR), F.coalesce(one_of(clean, names), one_of(_key(clean), names), _key(clean)))


def action_match(text: Column) -> Column:
    """Match, mismatch or unclear; null for nothing."""
    clean = F.lower(stripped(text))
    key = _key(clean)
    told = F.when(key.isin(*SAME), "match").when(key.isin(*OTHER) | any_of(key, ("mismatch", "different", "wrong")), "mismatch").when(any_of(key, ("match", "correct", "same")), "match").otherwise("unclear")
    return F.when(~clean.isin(*OPEN), told)


def human(n: Column, precision: int = 0) -> Column:
    """A number with K, M, B, T or Q, rounded half to even; beyond those, in units of 1000 Q."""
    x, out = n.cast("double"), None
    for suffix in ("", "K", "M", "B", "T", "Q"):
        number = F.bround(x, precision)
        text = F.concat(number.cast("decimal(20,0)").cast("string") if precision == 0 else F.format_string(f"%.{precision}f", number), F.lit(suffix))
        out = F.when(F.abs(x) < 1000, text) if out is None else out.when(F.abs(x) < 1000, text)
        x = x / 1000
    return out.otherwise(x.cast("string"))


def episode_path(episode: Column, chunk: int = 1000) -> Column:
    """X18."""
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / chunk).cast("long"), episode)


def truth(text: Column) -> Column:
    """true, false or null for words and numbers that say so."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "y", "t"), True).when(t.isin("false", "no", "n", "f"), False).otherwise(t.try_cast("double") > 0.5)


def task_tokens(spec: str) -> list[str]:
    """tokens of a list of tasks, split at commas and line ends."""
    return [t for t in (x.strip() for x in re.split(r"[,\n]", spec)) if t]


def episode_range(spec: str | None) -> tuple[int, int] | None:
    """START:END, with 0 <= START < END."""
    if spec is None or not spec.strip():
        return None
    found = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", spec)
    if not found or int(found[1]) >= int(found[2]):
        raise ValueError(f"a range of episodes is START:END with 0 <= START < END, not {spec!r}")
    return int(found[1]), int(found[2])
