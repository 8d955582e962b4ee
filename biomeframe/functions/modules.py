"""Parser of pathway-module definitions.

``+`` or a blank is AND, ``,`` is OR, parentheses nest; ``-X`` is optional and left out, ``--`` stands for nothing.
A term that names another module is that module's definition in parentheses; cycles are errors.
The result is a disjunctive normal form: alternatives, each a set of terms.
"""

from __future__ import annotations

import re

Alternatives = list[frozenset[str]]


def clean_definition(text: str) -> str:
    """Without optional terms and ``--``, with ``+`` for AND."""
    text = re.sub(r"\s*--\s*", " ", text.rstrip())
    text = re.sub(r"-\w+", "", text)
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"\s*([,()])\s*", lambda m: m[1], text) if "," in text else text
    text = re.sub(r"(?<=[\w)])\s*(?=\()", "+", text)
    text = re.sub(r"(?<=\))\s*(?=\w)", "+", text)
    return text.replace(" ", "+")


def expand_definition(text: str, definitions: dict[str, str] | None = None) -> Alternatives:
    """Distinct alternatives, in order of first appearance."""
    return _expand(text, definitions or {}, ())


def _expand(text: str, definitions: dict[str, str], open_: tuple[str, ...]) -> Alternatives:
    tokens = re.findall(r"\w+|[(),+]", clean_definition(text))
    at = 0

    def either() -> Alternatives:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == ",":
            at += 1
            out += both()
        return list(dict.fromkeys(out))

    def both() -> Alternatives:
        nonlocal at
        out = [frozenset()]
        while at < len(tokens) and tokens[at] not in (",", ")"):
            if tokens[at] == "+":
                at += 1
                continue
            right = one()
            out = [a | b for a in out for b in right]
        return out

    def one() -> Alternatives:
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"unbalanced parentheses in {text!r}")
            at += 1
            return inner
        if token in definitions:
            if token in open_:
                raise ValueError(f"module {token} refers to itself")
            return _expand(definitions[token], definitions, (*open_, token))
        return [frozenset([token])]

    out = [a for a in either() if a]
    if at != len(tokens):
        raise ValueError(f"unbalanced parentheses in {text!r}")
    return out


def parse_modules(definitions: dict[str, str]) -> dict[str, Alternatives]:
    """Alternatives of each module; sub-modules are resolved."""
    return {name: _expand(text, definitions, (name,)) for name, text in definitions.items()}
