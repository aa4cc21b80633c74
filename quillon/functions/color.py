"""Colors and shadows as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named colors.
NAMED = {
    "aqua": (0, 255, 255, 1), "azure": (240, 255, 255, 1), "beige": (245, 245, 220, 1), "black": (0, 0, 0, 1),
    "blue": (0, 0, 255, 1), "brown": (165, 42, 42, 1), "cyan": (0, 255, 255, 1), "darkblue": (0, 0, 139, 1),
    "darkcyan": (0, 139, 139, 1), "darkgrey": (169, 169, 169, 1), "darkgreen": (0, 100, 0, 1),
    "darkkhaki": (189, 183, 107, 1), "darkmagenta": (139, 0, 139, 1), "darkolivegreen": (85, 107, 47, 1),
    "darkorange": (255, 140, 0, 1), "darkorchid": (153, 50, 204, 1), "darkred": (139, 0, 0, 1),
    "darksalmon": (233, 150, 122, 1), "darkviolet": (148, 0, 211, 1), "fuchsia": (255, 0, 255, 1), "gold": (255, 215, 0, 1),
    "green": (0, 128, 0, 1), "indigo": (75, 0, 130, 1), "khaki": (240, 230, 140, 1), "lightblue": (173, 216, 230, 1),
    "lightcyan": (224, 255, 255, 1), "lightgreen": (144, 238, 144, 1), "lightgrey": (211, 211, 211, 1),
    "lightpink": (255, 182, 193, 1), "lightyellow": (255, 255, 224, 1), "lime": (0, 255, 0, 1), "magenta": (255, 0, 255, 1),
    "maroon": (128, 0, 0, 1), "navy": (0, 0, 128, 1), "olive": (128, 128, 0, 1), "orange": (255, 165, 0, 1),
    "pink": (255, 192, 203, 1), "purple": (128, 0, 128, 1), "violet": (128, 0, 128, 1), "red": (255, 0, 0, 1),
    "silver": (192, 192, 192, 1), "white": (255, 255, 255, 1), "yellow": (255, 255, 0, 1), "transparent": (255, 255, 255, 0),
}

HEX = "0123456789abcdefABCDEF"
SHADOW = "struct<inset:boolean,left:int,top:int,blur:int,spread:int,color:array<double>>"


def _made_of(text: Column, letters: str) -> Column:
    """Whether a text has some letters, all of them from a list."""
    return (text != "") & (F.translate(text, letters, "") == "")


def _hex_color(code: Column) -> Column:
    """'#' and three or six hexadecimal digits; of three, each stands for two."""
    digits = F.substring(code, 2, 7)
    pair = lambda k: F.when(F.length(digits) == 3, F.repeat(F.substring(digits, k + 1, 1), 2)).otherwise(F.substring(digits, 2 * k + 1, 2))
    color = F.array(*[F.conv(pair(k), 16, 10).try_cast("double") for k in range(3)], F.lit(1.0))
    return F.when(F.startswith(code, F.lit("#")) & _made_of(digits, HEX) & F.length(digits).isin(3, 6), color)


def _start(number: Column) -> Column:
    """The whole number that a text starts with; null if it starts with none."""
    return F.regexp_extract(number, "^-?[0-9]+", 0).try_cast("int")


def _called_color(name: Column, arguments: Column) -> Column:
    """'rgb' with three numbers or 'rgba' with four. Numbers are read as far as they go."""
    given = F.transform(arguments, lambda x: F.trim(x))
    wanted = F.when(name == "rgb", 3).when(name == "rgba", 4)
    fits = (F.size(given) == wanted) & F.forall(given, lambda x: _made_of(x, "0123456789."))
    alpha = F.regexp_extract(F.get(given, F.lit(3)), r"^[0-9]*\.?[0-9]*", 0).try_cast("double")
    color = F.array(*[_start(F.get(given, F.lit(k))).cast("double") for k in range(3)], F.when(name == "rgba", alpha).otherwise(F.lit(1.0)))
    return F.when(fits, color)


def parse_color(text: Column) -> Column:
    """array(red, green, blue, alpha) as doubles, of a text that is one color: '#' with digits, a call of rgb or rgba, or a name;
    null for anything else. Blanks around it, and around the numbers of a call, do not count."""
    named = F.create_map(*[x for k, v in NAMED.items() for x in (F.lit(k), F.array(*[F.lit(float(c)) for c in v]))])
    word = F.trim(text)
    call = F.split(F.substring(word, F.lit(1), F.length(word) - 1), r"\(")
    called = F.when(F.endswith(word, F.lit(")")) & (F.size(call) == 2), _called_color(F.get(call, F.lit(0)), F.split(F.get(call, F.lit(1)), ",")))
    return F.coalesce(_hex_color(word), called, F.try_element_at(named, word))


def mix_colors(a: Column, b: Column, at: Column) -> Column:
    """Between two colors: whole numbers towards zero for red, green and blue, a plain number for alpha."""
    part = lambda k: F.get(a, F.lit(k)) + at * (F.get(b, F.lit(k)) - F.get(a, F.lit(k)))
    return F.array(*[part(k).cast("int").cast("double") for k in range(3)], part(3))


def color_text(color: Column) -> Column:
    """rgba(r,g,b,a)"""
    whole = [F.get(color, F.lit(k)).cast("int").cast("string") for k in range(3)]
    return F.concat(F.lit("rgba("), F.array_join(F.array(*whole), ","), F.lit(","), F.get(color, F.lit(3)).cast("string"), F.lit(")"))


#: Tokens of a shadow list: blanks, marks, and words, which are whatever stands between them.
TOKEN = r"\s+|[(),]|[^\s(),]+"
HELD = f"struct<done:array<{SHADOW}>,now:{SHADOW},sizes:array<string>,call:string,reading:boolean>"


def parse_shadows(text: Column) -> Column:
    """The shadows of a list like 'inset 1px 2px 3px #000, 0 0 4px rgba(0,0,0,.5)', read from the left to the first word
    that is no part of a shadow; null for null. A blank at the start is no part of one.

    A part is 'inset', two to four sizes (numbers, with px or without) or a color; the last of each kind counts. A comma begins
    the next shadow. Sizes that are not given are 0, and a color is null; numbers are read as far as they go, and null where
    they cannot be. The text is cut into tokens once, and one pass over them keeps the shadows that are done, the one at hand, the sizes
    in a row and the call that is open.
    """
    empty = F.struct(F.lit(False), *[F.lit(0)] * 4, F.lit(None)).cast(SHADOW)
    names = ("left", "top", "blur", "spread")

    def held_as(held: Column, **changes: Column) -> Column:
        return F.struct(*[changes.get(c, held[c]).alias(c) for c in ("done", "now", "sizes", "call", "reading")]).cast(HELD)

    def changed(now: Column, **changes: Column) -> Column:
        return F.struct(*[changes.get(c, now[c]).alias(c) for c in ("inset", *names, "color")]).cast(SHADOW)

    def with_sizes(held: Column) -> Column:
        """The shadow at hand with the sizes in a row, if they are enough."""
        given = lambda k: F.when(F.size(held["sizes"]) > k, _start(F.get(held["sizes"], F.lit(k)))).otherwise(F.lit(0))
        return F.when(F.size(held["sizes"]) >= 2, changed(held["now"], **{c: given(k) for k, c in enumerate(names)})).otherwise(held["now"])

    def in_call(held: Column, token: Column) -> Column:
        parts = F.split(held["call"], r"\(")
        color = F.when(F.size(parts) == 2, _called_color(F.trim(F.get(parts, F.lit(0))), F.split(F.get(parts, F.lit(1)), ",")))
        closed = held_as(held, now=changed(held["now"], color=F.coalesce(color, held["now"]["color"])), call=F.lit(""), reading=color.isNotNull())
        return F.when(token == ")", closed).otherwise(held_as(held, call=F.concat(held["call"], F.lit(" "), token)))

    def at_word(held: Column, token: Column) -> Column:
        now, none = with_sizes(held), F.array().cast("array<string>")
        color = _hex_color(token)
        return (
            F.when(F.size(held["sizes"]) == 1, held_as(held, sizes=none, reading=F.lit(False)))
            .when(token == "inset", held_as(held, now=changed(now, inset=F.lit(True)), sizes=none))
            .when(token == ",", held_as(held, done=F.array_append(held["done"], now), now=empty, sizes=none))
            .when(token.isin("rgb", "rgba"), held_as(held, now=now, sizes=none, call=token))
            .when(color.isNotNull(), held_as(held, now=changed(now, color=color), sizes=none))
            .otherwise(held_as(held, now=now, sizes=none, reading=F.lit(False)))
        )

    def step(held: Column, token: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(token, "px$", ""), "^-", "")
        full = F.size(held["sizes"]) == 4
        size = held_as(held, now=F.when(full, with_sizes(held)).otherwise(held["now"]), sizes=F.when(full, F.array(token)).otherwise(F.array_append(held["sizes"], token)))
        return (
            F.when(~held["reading"], held).when(held["call"] != "", in_call(held, token))
            .when(_made_of(bare, "0123456789."), size).otherwise(at_word(held, token))
        )

    tokens = F.filter(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")
    start = F.struct(F.array().alias("done"), empty.alias("now"), F.array().alias("sizes"), F.lit("").alias("call"), ~F.regexp_like(text, F.lit(r"^\s"))).cast(HELD)
    found = F.aggregate(tokens, start, step, lambda held: F.array_append(held["done"], with_sizes(held)))
    return F.when(text.isNotNull(), found)


def padded_pairs(a: Column, b: Column) -> Column:
    """Two lists side by side: array of struct(a, b), the shorter filled up with null."""
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
