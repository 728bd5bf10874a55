"""Word boundaries by the default rules of Unicode's text segmentation (UAX #29), as one regular expression.

The rules say between which classes of characters no boundary is; written as a grammar of what is inside a word, they
are an expression over classes that both pattern engines know by their properties:

* marks, joiners and format characters belong to the character before them (WB4);
* letters hold together, also across one of `'`, `.`, `:` and their kin (WB5 to WB7), a Hebrew letter also with a
  quotation mark between or an apostrophe behind (WB7a to c); digits, also across `.`, `,`, `;` and their kin (WB8, WB11,
  WB12); letters and digits with one another (WB9, WB10); Katakana with itself (WB13);
* connectors such as `_` join what they stand next to (WB13a, b), but a run of them alone is no word.

Ideographs and Hiragana are words of one character each. Thai, Lao, Khmer and Myanmar, which only a dictionary could
divide, are words of one run each. Punctuation, symbols and emoji are no words. Groups are possessive: the classes that
may follow one another have no character in common, so matches are the same, and no text makes the engine recurse.

Most words are letters of Latin-1 up to a blank or a mark that no word goes on with: these are tried first, by one class
of a few ranges; and no match is tried at blanks, full stops and commas. Both leave the words as the rules have them.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Members of the classes that general properties don't give. Fixed values.
MID_LETTER = r":··՟״‧︓﹕："
MID_BOTH = r".'‘’․﹒＇．"
MID_NUMBER = r",;;։،؍٬߸⁄︐︔﹐﹔，；"
CONNECTORS, KATAKANA_TOO, NO_FORMAT = r"\p{Pc} ", r"ーｰ", r"​"
#: Letters of Latin-1, all of them in the class of letters; what ends a word of these; what none begins with.
LATIN, ENDS, NO_BEGINNING = r"a-zA-Zà-öø-ÿ", r" \t\n\r,;!?()", r" \n.,"
DICTIONARY_SCRIPTS = ("Thai", "Lao", "Khmer", "Myanmar")


def _expression(script: Callable[[str], str], alphabetic: str, ideographic: str, less: Callable[[str, str], str]) -> str:
    """For an engine, by how it names scripts and properties, and takes one class out of another."""
    hiragana, hebrew, runs = script("Hiragana"), script("Hebrew"), "".join(map(script, DICTIONARY_SCRIPTS))
    x = less(r"\p{M}\p{Cf}", NO_FORMAT) + "*+"
    letter = rf"(?:[{LATIN}]++|" + less(alphabetic, rf"\p{{M}}{ideographic}{hiragana}{script('Katakana')}{runs}") + ")" + x
    number, katakana, join = r"(?:[0-9]++|\p{Nd})" + x, f"[{script('Katakana')}{KATAKANA_TOO}]{x}", f"[{CONNECTORS}]{x}"
    quoted = rf"(?<=[{hebrew}])\"{x}[{hebrew}]{x}(?:{letter})*+"
    letters = rf"(?:{letter})++(?:[{MID_LETTER}{MID_BOTH}]{x}(?:{letter})++|{quoted})*+(?:(?<=[{hebrew}])')?+"
    numbers = rf"(?:{number})++(?:[{MID_NUMBER}{MID_BOTH}]{x}(?:{number})++)*+"
    core = rf"(?:(?:{letters}|{numbers})++|(?:{katakana})++)"
    first = rf"(?:(?=[{CONNECTORS}])(?<![{CONNECTORS}\p{{M}}\p{{Cf}}])(?:{join})++)?+"  # a run is tried from its beginning only
    plain = rf"[{LATIN}]++(?![^{ENDS}])"
    return rf"(?![{NO_BEGINNING}])(?:{plain}|{first}{core}(?:(?:{join})++{core})*+(?:{join})*+|{ideographic}{x}|[{hiragana}]{x}|(?:[{runs}]{x})++)"


JAVA_WORD = _expression(lambda name: rf"\p{{Is{name}}}", r"\p{IsAlphabetic}", r"\p{IsIdeographic}", lambda a, b: f"[{a}&&[^{b}]]")
_WORD = regex.compile(_expression(lambda name: rf"\p{{Script={name}}}", r"\p{Alphabetic}", r"\p{Ideographic}", lambda a, b: f"[[{a}]--[{b}]]"), regex.V1)


def words_of(text: str) -> list[str]:
    """The words of a text, as `JAVA_WORD` finds them in columns."""
    return _WORD.findall(text)
