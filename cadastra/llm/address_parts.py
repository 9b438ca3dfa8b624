"""Parts of a typed postal address: city, district, street office, road and door."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from ..functions.columns import FILLERS
from .hanzi import CONFUSED_ROAD, NUM, fold, number

#: Short and foreign forms of road kinds, written after the road's name.
ROAD_KINDS = {"大街": "大街", "大st": "大街", "大道": "大道", "路": "路", "rd": "路", "街": "街", "st": "街", "巷": "巷", "ln": "巷", "道": "道"}
_HAN = "一-鿿"
_OFFICE = re.compile(rf"([{_HAN}]{{2}})(?:街道办事处|街道|街办)")
_ROAD = re.compile(rf"([{_HAN}]{{2}})([东南西北中]|[一二三四五六七八九十](?=巷|ln))?(大街|大st|大道|路|rd|街(?!道|办)|st|巷|ln|道)")
_AFTER = re.compile(rf"^[^0-9a-z{_HAN}]*(?:门牌号?|no\.?|第)?\s*([甲乙丙丁])?\s*({NUM})(\s*[号#]院?|院)?")
_INNER = re.compile(r"\s*(?:楼|栋|幢|单元|层|室|-\d)")
_PROVINCE = re.compile(rf"[{_HAN}]{{2,3}}省")
_CITY = re.compile(rf"([{_HAN}]{{2,3}})市(?!场)")
_BEFORE = re.compile(rf"(?:门牌号?|no\.?|第)?\s*([甲乙丙丁])?\s*({NUM})\s*(?:[号#]院?|院)?[^0-9a-z{_HAN}]*$")
_DISTRICT = re.compile(rf"([{_HAN}]{{2}})(?:区|县)")


class Address(NamedTuple):
    """city and district without their last character, street office, road as base|side|kind, door as 甲12
    (empty where the text names none)."""

    city: str
    district: str
    office: str
    road: str
    door: str


NOWHERE = Address("", "", "", "", "")


@lru_cache(maxsize=10_000)
def short(name: str | None, ends: str) -> str:
    """A place name in usual form without its kind (one of `ends`); empty for blank ones."""
    if not name or (t := "".join(fold(name).split())) in FILLERS:
        return ""
    return t[:-1] if t[-1] in ends and len(t) > 2 else t


@lru_cache(maxsize=10_000)
def office_of(street: str | None) -> str:
    """A street office's name without its kind."""
    if not street or (t := "".join(fold(street).split())) in FILLERS:
        return ""
    return re.sub(r"(街道办事处|街道|街办|办事处)$", "", t)


def _close_up(s: str) -> str:
    """Without blanks, but for those between digits."""
    words = s.split()
    out = words[0]
    for w in words[1:]:
        out += " " + w if out[-1].isdigit() and w[0].isdigit() else w
    return out


def parse_address(address: str | None, province: str | None = None, city: str | None = None, district: str | None = None, street: str | None = None, typed: bool = False) -> Address:
    """Parts of an address; what it leaves out comes from the columns of its row. With `typed` the road keeps its characters,
    else look-alikes are folded."""
    p, c, d, o = short(province, "省"), short(city, "市"), short(district, "区县"), office_of(street)
    if not address or not (s := fold(address).strip()) or s in FILLERS:
        return Address(c, d, o, "", "")
    s = _close_up(s)
    if ("街道" in s or "街办" in s) and (m := _OFFICE.search(s)):
        o = o or m[1]
        s = s[: m.start()] + " " + s[m.end() :]
    if "省" in s:
        s = s.replace(p + "省", " ", 1) if p and p + "省" in s else _PROVINCE.sub(" ", s, count=1)
    if c and c + "市" in s:
        s = s.replace(c + "市", " ", 1)
    elif not c and (m := _CITY.search(s)):
        c, s = m[1], s[: m.start()] + " " + s[m.end() :]
    for name in (p, c):  # short forms
        if name and name in s:
            s = s.replace(name, " ", 1)
    if d and (d + "区" in s or d + "县" in s):
        at = s.index(d + "区") if d + "区" in s else s.index(d + "县")
        s = s[:at] + " " + s[at + len(d) + 1 :]
    elif m := _DISTRICT.search(s):
        d, s = d or m[1], s[: m.start()] + " " + s[m.end() :]
    if d and d in s:
        s = s.replace(d, " ", 1)
    m = _ROAD.search(s)
    if not m:
        return Address(c, d, o, "", "")
    road = f"{m[1] if typed else m[1].translate(CONFUSED_ROAD)}|{m[2] or ''}|{ROAD_KINDS[m[3]]}"
    door, tail = "", s[m.end() :]
    if (a := _AFTER.match(tail)) and not _INNER.match(tail, a.end()) and (value := number(a[2])):
        door = f"{a[1] or ''}{value}"
    elif (b := _BEFORE.search(s[: m.start()])) and (value := number(b[2])):
        door = f"{b[1] or ''}{value}"
    return Address(c, d, o, road, door)
