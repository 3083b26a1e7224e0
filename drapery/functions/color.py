"""Colour column functions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import classify_by_rules, joined
from .text import col, let, title_case

# Pattern words first, then colour families, in this order.
COLOR_PATTERN_RULES = [
    ("Striped", ["stripe", "striped"]),
    ("Floral", ["floral", "flower", "botanical"]),
    ("Patterned", ["print", "pattern", "geometric", "abstract"]),
]
COLOR_FAMILY_RULES = [
    ("Black", ["black", "noir", "onyx", "midnight"]),
    ("White", ["white", "ivory", "cream", "off-white", "bone"]),
    ("Red", ["red", "crimson", "ruby", "burgundy", "wine", "maroon"]),
    ("Blue", ["blue", "navy", "indigo", "cobalt", "sapphire", "denim"]),
    ("Green", ["green", "olive", "forest", "emerald", "sage", "mint"]),
    ("Yellow", ["yellow", "gold", "mustard", "lemon"]),
    ("Orange", ["orange", "coral", "peach", "tangerine"]),
    ("Pink", ["pink", "rose", "blush", "fuchsia", "magenta"]),
    ("Purple", ["purple", "violet", "plum", "lavender", "lilac"]),
    ("Brown", ["brown", "tan", "beige", "khaki", "camel", "chocolate"]),
    ("Gray", ["gray", "grey", "silver", "charcoal", "slate"]),
    ("Multicolor", ["multi", "rainbow", "tie-dye", "tie dye", "colorful"]),
]

# Fixed value: v1 colour words recognised at the start of a slug.
SLUG_COLOR_WORDS = ["black", "white", "red", "blue", "green", "navy", "olive", "pink", "grey", "gray", "brown",
                    "beige", "tan", "orange", "yellow", "purple", "maroon", "burgundy", "cream", "ivory",
                    "charcoal", "teal", "coral", "mint", "sage", "lavender", "plum", "indigo", "khaki", "mustard",
                    "rust", "wine", "blush", "nude", "taupe", "slate", "mauve", "turquoise", "fuchsia", "magenta",
                    "silver", "gold", "rose", "sand", "camel", "mocha", "espresso", "chocolate", "midnight",
                    "pewter"]


def normalize_color(color_name, title, description) -> Column:
    """Pattern words, then colour families over colour+title+description;
    else the title-cased colour, else 'Neutral'."""
    fallback = F.when(F.coalesce(col(color_name), F.lit("")) != "", title_case(color_name)).otherwise(F.lit("Neutral"))
    return classify_by_rules(joined(color_name, title, description), COLOR_PATTERN_RULES + COLOR_FAMILY_RULES,
                             fallback)


def infer_color_from_slug(slug) -> Column:
    """First listed colour word that the slug starts with (``word-``), capitalised."""
    words = F.array(*[F.lit(w) for w in SLUG_COLOR_WORDS])
    return let(F.lower(col(slug)), lambda s: F.initcap(F.get(F.filter(words, lambda w: s.startswith(F.concat(w, F.lit("-")))), 0)))


def hex_rgb(hex_code) -> Column:
    """``struct<r,g,b>`` of a ``#RRGGBB`` / ``RRGGBB`` text; null when malformed."""
    h = F.regexp_replace(col(hex_code), "^#+", "")
    ok = h.rlike("^[0-9A-Fa-f]{6}")

    def chan(i):
        return F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(ok, F.struct(chan(1).alias("r"), chan(3).alias("g"), chan(5).alias("b")))


def color_family_of_hex(hex_code) -> Column:
    """Brightness / spread / dominant-channel rule; bad input -> 'Neutral'."""
    def body(c):
        r, g, b = c["r"], c["g"], c["b"]
        hi, lo = F.greatest(r, g, b), F.least(r, g, b)
        bright = (r + g + b) / 3.0
        return (F.when(c.isNull(), F.lit("Neutral"))
                .when(hi - lo < 30, F.when(bright < 50, F.lit("Black")).when(bright > 200, F.lit("White"))
                      .otherwise(F.lit("Gray")))
                .when((r > g) & (r > b), F.when(g > 100, F.when(b < 100, F.lit("Orange")).otherwise(F.lit("Pink")))
                      .otherwise(F.lit("Red")))
                .when((g > r) & (g > b), F.lit("Green"))
                .when((b > r) & (b > g), F.when(r > 100, F.lit("Purple")).otherwise(F.lit("Blue")))
                .otherwise(F.lit("Neutral")))
    h = F.coalesce(col(hex_code), F.lit(""))
    return F.when(h == "", F.lit("Neutral")).otherwise(let(hex_rgb(h), body))


def rgb_to_hex(r, g, b) -> Column:
    """``#RRGGBB`` upper-case."""
    def two(c):
        return F.lpad(F.upper(F.hex(col(c).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


# Fixed value: CSS3 extended colour keywords (name, hex), alphabetical.
CSS3_COLORS = [
    ("aliceblue", "#f0f8ff"), ("antiquewhite", "#faebd7"), ("aqua", "#00ffff"), ("aquamarine", "#7fffd4"),
    ("azure", "#f0ffff"), ("beige", "#f5f5dc"), ("bisque", "#ffe4c4"), ("black", "#000000"),
    ("blanchedalmond", "#ffebcd"), ("blue", "#0000ff"), ("blueviolet", "#8a2be2"), ("brown", "#a52a2a"),
    ("burlywood", "#deb887"), ("cadetblue", "#5f9ea0"), ("chartreuse", "#7fff00"), ("chocolate", "#d2691e"),
    ("coral", "#ff7f50"), ("cornflowerblue", "#6495ed"), ("cornsilk", "#fff8dc"), ("crimson", "#dc143c"),
    ("cyan", "#00ffff"), ("darkblue", "#00008b"), ("darkcyan", "#008b8b"), ("darkgoldenrod", "#b8860b"),
    ("darkgray", "#a9a9a9"), ("darkgreen", "#006400"), ("darkgrey", "#a9a9a9"), ("darkkhaki", "#bdb76b"),
    ("darkmagenta", "#8b008b"), ("darkolivegreen", "#556b2f"), ("darkorange", "#ff8c00"),
    ("darkorchid", "#9932cc"), ("darkred", "#8b0000"), ("darksalmon", "#e9967a"), ("darkseagreen", "#8fbc8f"),
    ("darkslateblue", "#483d8b"), ("darkslategray", "#2f4f4f"), ("darkslategrey", "#2f4f4f"),
    ("darkturquoise", "#00ced1"), ("darkviolet", "#9400d3"), ("deeppink", "#ff1493"),
    ("deepskyblue", "#00bfff"), ("dimgray", "#696969"), ("dimgrey", "#696969"), ("dodgerblue", "#1e90ff"),
    ("firebrick", "#b22222"), ("floralwhite", "#fffaf0"), ("forestgreen", "#228b22"), ("fuchsia", "#ff00ff"),
    ("gainsboro", "#dcdcdc"), ("ghostwhite", "#f8f8ff"), ("gold", "#ffd700"), ("goldenrod", "#daa520"),
    ("gray", "#808080"), ("grey", "#808080"), ("green", "#008000"), ("greenyellow", "#adff2f"),
    ("honeydew", "#f0fff0"), ("hotpink", "#ff69b4"), ("indianred", "#cd5c5c"), ("indigo", "#4b0082"),
    ("ivory", "#fffff0"), ("khaki", "#f0e68c"), ("lavender", "#e6e6fa"), ("lavenderblush", "#fff0f5"),
    ("lawngreen", "#7cfc00"), ("lemonchiffon", "#fffacd"), ("lightblue", "#add8e6"), ("lightcoral", "#f08080"),
    ("lightcyan", "#e0ffff"), ("lightgoldenrodyellow", "#fafad2"), ("lightgray", "#d3d3d3"),
    ("lightgreen", "#90ee90"), ("lightgrey", "#d3d3d3"), ("lightpink", "#ffb6c1"), ("lightsalmon", "#ffa07a"),
    ("lightseagreen", "#20b2aa"), ("lightskyblue", "#87cefa"), ("lightslategray", "#778899"),
    ("lightslategrey", "#778899"), ("lightsteelblue", "#b0c4de"), ("lightyellow", "#ffffe0"),
    ("lime", "#00ff00"), ("limegreen", "#32cd32"), ("linen", "#faf0e6"), ("magenta", "#ff00ff"),
    ("maroon", "#800000"), ("mediumaquamarine", "#66cdaa"), ("mediumblue", "#0000cd"),
    ("mediumorchid", "#ba55d3"), ("mediumpurple", "#9370db"), ("mediumseagreen", "#3cb371"),
    ("mediumslateblue", "#7b68ee"), ("mediumspringgreen", "#00fa9a"), ("mediumturquoise", "#48d1cc"),
    ("mediumvioletred", "#c71585"), ("midnightblue", "#191970"), ("mintcream", "#f5fffa"),
    ("mistyrose", "#ffe4e1"), ("moccasin", "#ffe4b5"), ("navajowhite", "#ffdead"), ("navy", "#000080"),
    ("oldlace", "#fdf5e6"), ("olive", "#808000"), ("olivedrab", "#6b8e23"), ("orange", "#ffa500"),
    ("orangered", "#ff4500"), ("orchid", "#da70d6"), ("palegoldenrod", "#eee8aa"), ("palegreen", "#98fb98"),
    ("paleturquoise", "#afeeee"), ("palevioletred", "#db7093"), ("papayawhip", "#ffefd5"),
    ("peachpuff", "#ffdab9"), ("peru", "#cd853f"), ("pink", "#ffc0cb"), ("plum", "#dda0dd"),
    ("powderblue", "#b0e0e6"), ("purple", "#800080"), ("red", "#ff0000"), ("rosybrown", "#bc8f8f"),
    ("royalblue", "#4169e1"), ("saddlebrown", "#8b4513"), ("salmon", "#fa8072"), ("sandybrown", "#f4a460"),
    ("seagreen", "#2e8b57"), ("seashell", "#fff5ee"), ("sienna", "#a0522d"), ("silver", "#c0c0c0"),
    ("skyblue", "#87ceeb"), ("slateblue", "#6a5acd"), ("slategray", "#708090"), ("slategrey", "#708090"),
    ("snow", "#fffafa"), ("springgreen", "#00ff7f"), ("steelblue", "#4682b4"), ("tan", "#d2b48c"),
    ("teal", "#008080"), ("thistle", "#d8bfd8"), ("tomato", "#ff6347"), ("turquoise", "#40e0d0"),
    ("violet", "#ee82ee"), ("wheat", "#f5deb3"), ("white", "#ffffff"), ("whitesmoke", "#f5f5f5"),
    ("yellow", "#ffff00"), ("yellowgreen", "#9acd32"),
]


#: Cells of the lookup cube along a channel, and their width.
CUBE, WIDE = 8, 32


def _palette() -> list[tuple[str, tuple[int, int, int]]]:
    """Names and values, one name a value (the later one in the list)."""
    return [(name, tuple(int(hx[i:i + 2], 16) for i in (1, 3, 5))) for hx, name in {hx: name for name, hx in CSS3_COLORS}.items()]


def _cube() -> list[list[int]]:
    """For each cell of the colour cube the palette entries that can be nearest
    to a colour in it: those not farther from its closest point than some entry
    is from its farthest one."""
    values, out = [v for _, v in _palette()], []
    for cell in range(CUBE ** 3):
        lo = [WIDE * (cell // CUBE ** k % CUBE) for k in (2, 1, 0)]
        near = [sum(max(a - x, 0, x - a - WIDE + 1) ** 2 for a, x in zip(lo, v)) for v in values]
        far = min(sum(max(abs(x - a), abs(x - a - WIDE + 1)) ** 2 for a, x in zip(lo, v)) for v in values)
        out.append([i for i, d in enumerate(near) if d <= far])
    return out


def css_color_nearest(hex_code) -> Column:
    """Name of the CSS3 colour at the smallest distance (squares of channel
    differences), the first in the list of those equally near; bad input ->
    'Default'. A row compares itself with its cell's few entries; no join."""
    palette = F.from_json(F.lit(json.dumps([{"n": n, "r": r, "g": g, "b": b} for n, (r, g, b) in _palette()])), "array<struct<n:string,r:int,g:int,b:int>>")
    cube = F.from_json(F.lit(json.dumps(_cube())), "array<array<int>>")

    def body(c: Column) -> Column:
        def scored(i: Column) -> Column:
            return let(F.get(palette, i), lambda p: F.struct(
                ((p["r"] - c["r"]) * (p["r"] - c["r"]) + (p["g"] - c["g"]) * (p["g"] - c["g"]) + (p["b"] - c["b"]) * (p["b"] - c["b"])).alias("d"), i.alias("i"), p["n"].alias("n")))

        cell = F.floor(c["r"] / WIDE) * CUBE ** 2 + F.floor(c["g"] / WIDE) * CUBE + F.floor(c["b"] / WIDE)
        return F.when(c.isNull(), "Default").otherwise(F.array_min(F.transform(F.get(cube, cell.cast("int")), scored))["n"])

    return let(hex_rgb(F.coalesce(col(hex_code), F.lit(""))), body)


def css_color_name(hex_code) -> Column:
    """Exact CSS3 name of a hex colour (``#`` optional, 3 or 6 digits), else
    'Default'. Where two names share a value the later one in the list wins."""
    by_hex = {}
    for name, hx in CSS3_COLORS:
        by_hex[hx] = name
    lookup = F.create_map(*[F.lit(x) for kv in by_hex.items() for x in kv])
    h = F.lower(F.regexp_replace(F.trim(F.coalesce(col(hex_code), F.lit(""))), "^#", ""))
    six = F.when(h.rlike("^[0-9a-f]{6}$"), h).when(
        h.rlike("^[0-9a-f]{3}$"),
        F.concat(F.repeat(F.substring(h, 1, 1), 2), F.repeat(F.substring(h, 2, 1), 2), F.repeat(F.substring(h, 3, 1), 2)))
    return F.coalesce(F.element_at(lookup, F.concat(F.lit("#"), six)), F.lit("Default"))
