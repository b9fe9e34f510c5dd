"""Label rules, section palette and placement: pure column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

UNSORTED = "_unsorted"
MAP_UNSORTED = "Unsorted"

# Keyword rules on a cleaned file name, first match wins.
KEYWORD_RULES: Rules = [
    ("808", r"808"),
    ("Kick", r"\bkick|\bbd\b|bass ?drum|\bbdrum"),
    ("Closed Hat", r"closed.?hat|closed.?hh|\bchh\b|\bchat\b|clsd|closed.?hi|closed.?cym"),
    ("Open Hat", r"open.?hat|open.?hh|\bohh\b|\bohat\b|open.?hi|open.?cym"),
    ("Rimshot", r"rim"),
    ("Crash", r"crash|china|splash"),
    ("Ride", r"\bride|sizzle"),
    ("Cymbal", r"cymbal|\bcym\b"),
    ("Cowbell", r"cowbell|cow.?bell"),
    ("Clap", r"\bclap|\bclp\b"),
    ("Snare", r"\bsnare|\bsnr\b|\bsd\b"),
    ("Tom", r"\btom\b|\btoms\b"),
    ("Shaker", r"shaker|\bshake"),
    ("Tambourine", r"tamb"),
    ("Conga", r"conga|bongo"),
    ("Snap", r"snap|finger"),
    ("Woodblock", r"wood.?block|\bclave"),
    ("Rolls", r"\broll(?!\s*(with|on|the|me|in|up))|buzz roll"),
    ("Vocal", r"vocal|\bvox\b|adlib|ad.?lib"),
    ("Bass", r"\bbass\b|\bsub\s?bass"),
]

# Folder names that say nothing specific; a parameter wherever it is used.
GRAB_BAG = r"\bpercs?\b|\bone.?shots?\b|\bmisc\b|\bfx\b"

# Section colours.
PALETTE = {
    "Kick": "#ff5e62",
    "808": "#e23abb",
    "Bass": "#b4d570",
    "Snare": "#3ad2e2",
    "Rimshot": "#20bf6b",
    "Clap": "#4b7bec",
    "Snap": "#e23a7d",
    "Closed Hat": "#fd9644",
    "Open Hat": "#fed330",
    "Ride": "#c982ed",
    "Crash": "#aa6040",
    "Cymbal": "#aa3ae2",
    "Tom": "#d7ca97",
    "Conga": "#92cd1d",
    "Cowbell": "#e689b1",
    "Shaker": "#b59734",
    "Tambourine": "#3ae24b",
    "Woodblock": "#97b7d7",
    "Rolls": "#d7a097",
    "Vocal": "#79cca3",
    "Unsorted": "#7079b8",
}
GREY = "#888888"

# Canonical section order of the preview map.
SECTION_ORDER = [
    "Kick", "808", "Bass", "Snare", "Rimshot", "Clap", "Snap", "Closed Hat", "Open Hat", "Cymbal",
    "Tom", "Conga", "Cowbell", "Shaker", "Tambourine", "Woodblock", "Rolls", "Vocal", "Unsorted",
]

# Golden angle and the preview ring's step.
GOLDEN_ANGLE = 2.399963
SLOT_STEP = 30.0


def keyword_label(text: Column, rules: Rules = KEYWORD_RULES) -> Column:
    """Label of the first rule whose pattern occurs in ``text``, else null."""
    return F.coalesce(*[F.when(text.rlike(_flags(p) + p), F.lit(label)) for label, p in rules])


def _flags(pattern: str) -> str:
    """Unicode classes only where a pattern uses a class: they cost several times the plain match."""
    return "(?Ud)" if "\\b" in pattern or "\\s" in pattern or "\\w" in pattern else "(?d)"


def path_label(path: Column, rules: Rules = KEYWORD_RULES, grab_bag: str = GRAB_BAG) -> Column:
    """A specific label from the whole path, ``_unsorted`` for grab-bag folders, else null."""
    lowered = F.lower(path)
    return F.coalesce(
        keyword_label(lowered, rules), F.when(lowered.rlike(_flags(grab_bag) + grab_bag), F.lit(UNSORTED))
    )


def overlay_label(folder_label: Column, name_label: Column) -> Column:
    """The file name's label overrides the folder's."""
    return F.coalesce(name_label, folder_label)


def recoverable(folder_label: Column, name_label: Column) -> Column:
    """False for grab-bag rows whose file name carries no label."""
    return ~((folder_label == UNSORTED) & name_label.isNull())


def search_weight(query: str, *fields: Column, miss: float = 0.12) -> Column:
    """1.0 when any field contains the query (any case) or the query is empty, else ``miss``."""
    if not query:
        return F.lit(1.0)
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.lower(field).contains(query.lower())
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(miss))


def label_hex(label: Column, palette: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(v) for kv in (palette or PALETTE).items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(GREY))


def hex_to_rgb(colour: Column) -> Column:
    """``struct(r, g, b)`` in 0..1; a malformed channel counts as 136."""
    digits = F.regexp_replace(colour, "^#+", "")

    def channel(at: int) -> Column:
        part = F.substring(digits, at, 2)
        value = F.when(part.rlike("^[0-9a-fA-F]{2}$"), F.conv(part, 16, 10).cast("double"))
        return F.coalesce(value, F.lit(136.0)) / 255.0

    return F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"))


def label_colour(label: Column, palette: dict[str, str] | None = None) -> Column:
    return hex_to_rgb(label_hex(label, palette))


def label_id(label: Column) -> Column:
    """Stable unsigned 32-bit id of a label."""
    return F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("long")


def sunflower(i: Column, n: Column, radius: Column | float) -> Column:
    """``struct(x, y)`` of point ``i`` among ``n`` on an evenly filled disc."""
    r = F.lit(radius) * F.sqrt((i + 0.5) / n) if not isinstance(radius, Column) else radius * F.sqrt((i + 0.5) / n)
    angle = i * F.lit(GOLDEN_ANGLE)
    return F.struct((r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def section_slot(section: Column, order: Sequence[str] = SECTION_ORDER, step: float = SLOT_STEP) -> Column:
    """``struct(x, y)`` of a section's preview slot; unknown sections share the last one."""
    pairs = []
    for i, name in enumerate(order):
        pairs += [F.lit(name), F.lit(float(i))]
    i = F.coalesce(F.try_element_at(F.create_map(*pairs), section), F.lit(float(len(order) - 1)))
    r, angle = F.lit(step) * F.sqrt(i + 0.5), i * F.lit(GOLDEN_ANGLE)
    return F.struct((r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def blob_disc_radius(total: Column | int, node_radius: float = 1.6) -> Column:
    """Radius of the disc that holds ``total`` unclassified nodes."""
    count = total if isinstance(total, Column) else F.lit(total)
    return 0.62 * F.sqrt(F.greatest(count, F.lit(1))) * (2 * node_radius + 1.0)


assert math.isclose(GOLDEN_ANGLE, math.pi * (3 - math.sqrt(5)), rel_tol=1e-6)
