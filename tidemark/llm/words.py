"""Words of a text without regard to case, punctuation, markup and typography."""

from __future__ import annotations

import html
import unicodedata

import regex

_INLINE = regex.compile(r"</?(?:a|abbr|b|cite|code|em|font|i|mark|s|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>", regex.I)
_TAG = regex.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = regex.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
#: note marks: [12], [a], [note 3], (12) right behind a word, ^12, superscript digits, daggers and asterisks
_NOTE = regex.compile(r"\[\s*(?:\^?\d{1,4}|\^?[a-z]|(?:note|fn|ref|citation|sic)[^\[\]]{0,20})\s*\]|\^\d{1,3}|[¹²³⁰-₟†‡*]", regex.I)
#: soft hyphens, zero-width characters and the like, inside words
_UNSEEN = regex.compile(r"[­​-‏‪-‮⁠-⁤﻿]")
#: a word divided at the end of a line
_DIVIDED = regex.compile(r"(?<=\p{L})[-‐‑]\s*\n\s*(?=\p{Ll})")
_APOSTROPHE = regex.compile(r"(?<=\w)['‘’ʼ`´＇](?=\w)")
#: points and commas inside a number
_POINT = regex.compile(r"(?<=\d)[.,](?=\d)")
_WORD = regex.compile(r"[^\W_]+")


def _without_comments(text: str) -> str:
    """Every part but markup comments; searched from the front once, however many openings are never closed."""
    parts, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        parts.append(text[at:start])
        at = end + 3
    return " ".join([*parts, text[at:]])


def words(text: str | None) -> list[str]:
    """The words in order; an empty list for NULL."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _without_comments(text)))
    text = _UNSEEN.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    text = _DIVIDED.sub("", _NOTE.sub("", text))
    text = unicodedata.normalize("NFKC", text).casefold()
    return _WORD.findall(_POINT.sub("", _APOSTROPHE.sub("", text)))
