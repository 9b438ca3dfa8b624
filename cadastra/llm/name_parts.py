"""Parts of a typed place name: kind, core, ending, phase, sub-area and courtyard."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from ..functions.columns import FILLERS
from .hanzi import CONFUSED, NUM, SYLLABLES, fold, number, split_latin, syllables

#: Endings of estates, and of works' dormitories with their short forms.
ESTATE_ENDS = ("名邸", "公寓", "大厦", "新村", "嘉园", "家园", "花园", "小区", "府", "苑")
DORM_ENDS = {"职工宿舍": "职工宿舍", "职工": "职工宿舍", "家属院": "家属院", "家属": "家属院", "生活区": "生活区", "生活": "生活区", "宿舍": "宿舍"}
#: Spoken endings that stand for any ending.
LOOSE_ENDS = ("那片大院", "那片", "老院", "大院", "院")
#: Works that have dormitories; the first character is also the short form.
WORKS = ("棉纺", "印染", "机床", "轴承", "仪表", "电缆", "水泵", "钢管", "玻璃", "木材", "造纸", "制药", "化工", "铸造", "农机", "粮库", "供电", "运输", "设计", "地质")
LATIN_ENDS = {"mingdi": "名邸", "gongyu": "公寓", "dasha": "大厦", "xincun": "新村", "jiayuan": "嘉园|家园", "huayuan": "花园", "xiaoqu": "小区", "fu": "府", "yuan": "苑"}
_SIDES = {"dong": "东", "nan": "南", "xi": "西", "bei": "北", "zhong": "中"}
_NOISE = re.compile(r"\[[^\]]*\]|\(?原\)|物业服务中心|物业|居委会|[东南西北正]门(?=$|[^一-鿿])|补录")
_COURT = re.compile(rf"(?:no\s*\.?|第)?\s*({NUM})\s*[号#]\s*院|no\s*\.?\s*({NUM})\s*院")
_PHASE = re.compile(rf"第?\s*({NUM}|[ivx]+)\s*期")
_AREA = re.compile(r"([a-h]|[东南西北中])\s*[区曲]")
_FORM = re.compile(r"[^0-9a-z〇一-鿿]+")
_LETTERS, _LETTER, _HAN, _MARKS = re.compile(r"[a-z]{2}"), re.compile(r"[a-z]"), re.compile(r"[一-鿿]"), re.compile(r"no\.?|[ivx]+期")
_GAP, _TWICE, _PARTICLE = re.compile(r"(?<=\d)\s+(?=\d)"), re.compile(r"([一-鿿])\1+"), re.compile(r"[儿啊子]")
_OUTER = re.compile(r"^\(?([一-鿿]{2}[区县])(?!$)|\(([一-鿿]{2}[区县])\)")
_END_FIRST = re.compile(r"\W*((?:名[邸邮]|公[寓寅]|大[厦夏]|新[村材]|嘉园|家园|花园|小区|[府俯苑宛]))(?:[儿啊子])?[·-]+\s*(?=[一-鿿]{2})")  # the ending first
_WORK_SIGNS = frozenset(c for w in WORKS for c in w)
_ENDING = re.compile(f"^(.+?)({'|'.join(ESTATE_ENDS)}|{'|'.join(LOOSE_ENDS)})$")
_MARKED = frozenset("期区县曲院门委务补原")
_STAFF = re.compile("(?<!化)[职工宿舍]{3,4}")
_NUMBER = re.compile(NUM)
_KNOWN = frozenset(SYLLABLES.values())
_CONFUSED = frozenset(map(chr, CONFUSED))


class Name(NamedTuple):
    """kind E (estate), D (dormitory) or empty (blank); core as typed (empty for Latin); sound: its syllables;
    bag: them in order of the alphabet; ends: possible endings joined by |, empty if unknown; parts: phase,
    sub-area and courtyard, as p2/aE/c6 (absent ones left out)."""

    kind: str
    core: str
    sound: str
    bag: str
    ends: str
    parts: str
    district: str


BLANK = Name("", "", "", "", "", "", "")


@lru_cache(maxsize=10_000)
def _places(*names: str | None) -> tuple[str, ...]:
    out = []
    for n in names:
        if n:
            f = fold(n).strip()
            out += [f, f[:-1]] if f[-1:] in "省市区县" and len(f) > 2 else [f + "市", f + "区", f + "县", f]
    return tuple(x for x in out if len(x) >= 2)


def _parts(phase: int | None, area: str | None, court: int | None) -> str:
    return "/".join(f"{k}{v}" for k, v in (("p", phase), ("a", area), ("c", court)) if v is not None)


def parse_name(name: str | None, province: str | None = None, city: str | None = None, district: str | None = None) -> Name:
    """Parts of a name; province, city and district are names that may be written before it."""
    if not name or not (s := fold(name)).strip() or s.strip() in FILLERS:
        return BLANK
    if _LETTERS.search(s) and len(_LETTER.findall(_MARKS.sub("", s))) >= 3 and len(_HAN.findall(s)) <= 2:
        return _latin(s)
    s = "".join(s.split())
    marked = not _MARKED.isdisjoint(s) or not s.isalpha()
    phase = area = court = None
    if marked:
        s = _GAP.sub("", _NOISE.sub(" ", s)).replace("小曲", "小区").replace("活曲", "活区")
        if "院" in s and (m := _COURT.search(s)):
            court, s = number(m[1] or m[2]), s[: m.start()] + " " + s[m.end() :]
        if "期" in s and (m := _PHASE.search(s)):
            phase, s = number(m[1]), s[: m.start()] + " " + s[m.end() :]
    found = ""
    outer = _places(district, city, province)
    for p in outer if marked or s.startswith(outer) else ():
        if p in s and len(_FORM.sub("", s)) - len(p) >= 2:
            s = s.replace(p, " ", 1)
            break
    else:
        if marked and (m := _OUTER.search(s)):
            word = m[1] or m[2]
            if not word.endswith("小区") and len(_FORM.sub("", s)) > len(word) + 1:
                found, s = word, s[: m.start()] + " " + s[m.end() :]
    for m in _AREA.finditer(s) if marked else ():
        if not (m[0].endswith("曲") and m.start() and s[m.start() - 1] not in " ()-·"):
            area, s = m[1], s[: m.start()] + " " + s[m.end() :]
            break
    s = _TWICE.sub(r"\1", s)
    if m := _END_FIRST.match(s):
        s = s[m.end() :] + m[1]
    if marked or " " in s:
        s = _FORM.sub("", s)
    s = _PARTICLE.sub("", s) or s
    s = _TWICE.sub(r"\1", s)
    parts = _parts(phase, area, court)
    if not _WORK_SIGNS.isdisjoint(s) and (d := _dorm(s)):
        return Name("D", d[0], d[0], d[0], d[1], parts, found)
    s = s.replace("新材", "新村")
    if not _CONFUSED.isdisjoint(s):
        s = _TWICE.sub(r"\1", s.translate(CONFUSED))
    if len(s) >= 3 and s[0] in "老小市":
        s = s[1:]
    if m := _ENDING.match(s):
        core, ends = m[1], m[2] if m[2] in ESTATE_ENDS else ""
    else:
        core, ends = s, ""
        for e in ESTATE_ENDS:  # an ending with its characters exchanged, or before the core
            if len(e) == 2 and len(s) > 3 and (s.endswith(e[::-1]) or s.startswith(e)):
                core, ends = (s[:-2] if s.endswith(e[::-1]) else s[2:]), e
                break
    y = syllables(core)
    return Name("E", core, " ".join(y), " ".join(sorted(y)), ends, parts, found)


def _dorm(s: str) -> tuple[str, str] | None:
    """(number and works, ending) of a dormitory's name, full or short."""
    t = s.translate({ord("缩"): "宿", ord("嘱"): "属", ord("话"): "活"})
    t = _STAFF.sub("职工宿舍", t)
    t = t[1:] if t[0] in "市老小" and len(t) > 3 else t
    ends = ""
    for e in (*DORM_ENDS, *LOOSE_ENDS):
        if t.endswith(e) or (t.startswith(e) and e in DORM_ENDS):
            ends = DORM_ENDS.get(e, "")
            t = t[: -len(e)] if t.endswith(e) else t[len(e) :]
            break
    n = _NUMBER.search(t)
    if not n or (value := number(n[0])) is None:
        return None
    rest = t.replace("第", "", 1).replace(n[0], "", 1)
    if not rest or len(rest) > 6:
        return None
    if len(rest) == 1:
        works = [w for w in WORKS if w[0] == rest]
    else:
        score = [(len(set(w) & set(rest)) + 0.1 * (rest[0] == w[0]), w) for w in WORKS]
        top = max(score)[0]
        works = [w for v, w in score if v == top] if top >= 1 else []
    return (f"{value}{works[0]}", ends) if len(works) == 1 else None


def _latin(s: str) -> Name:
    t = re.sub(r"[^a-z0-9一-鿿]+", " ", _NOISE.sub(" ", s)).strip()
    j = t.replace(" ", "")
    phase = area = court = None
    if m := re.search(r"(\d+)(?:haoyuan|号院|院)", j):
        court, j = int(m[1]), j[: m.start()] + j[m.end() :]
    if m := re.search(r"(\d+)(?:qi|期)", j):
        phase, j = int(m[1]), j[: m.start()] + j[m.end() :]
    if m := re.search(r"(?:\b|(?<=[a-z]))(dong|nan|xi|bei|zhong)(?:qu|区)$", j):
        if not j.endswith("xiaoqu"):
            area, j = _SIDES[m[1]], j[: m.start()]
    elif (m := re.search(r"([a-h])(?:qu|区)$", j)) and not j.endswith("xiaoqu"):
        area, j = m[1], j[: m.start()]
    ends = ""
    for e, v in LATIN_ENDS.items():
        if j.endswith(e) and (y := split_latin(j[: -len(e)], _KNOWN)):
            ends = v
            return Name("E", "", " ".join(y), " ".join(sorted(y)), ends, _parts(phase, area, court), "")
    y = split_latin(j, _KNOWN) or [j]
    return Name("E", "", " ".join(y), " ".join(sorted(y)), ends, _parts(phase, area, court), "")
