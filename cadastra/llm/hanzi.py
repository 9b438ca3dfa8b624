"""Folding of Chinese place text: widths, traditional forms, confusable characters, numerals, syllables."""

from __future__ import annotations

import unicodedata

#: Traditional and variant forms and the usual form of each.
_FORMS = (
    "號号 園园 區区 觀观 寧宁 遠远 嶺岭 鶴鹤 聽听 匯汇 滙汇 潤润 錦锦 雲云 禦御 藍蓝 鷺鹭 嶼屿 澤泽 廠厂 東东 機机 電电 舎舍 紡纺 門门 灣湾 橋桥 莊庄 "
    "樓楼 棟栋 單单 層层 縣县 陽阳 陰阴 樺桦 楓枫 蘭兰 棗枣 楊杨 風风 場场 閣阁 蔭荫 業业 務务 設设 計计 農农 藥药 鑄铸 質质 隊队 運运 輸输 庫库 糧粮 "
    "纜缆 軸轴 儀仪 鋼钢 職职 屬属 漢汉 龍龙 鳳凤 麗丽 華华 國国 廣广 義义 禮礼 順顺 暉晖 溝沟 壩坝 條条 幾几 兒儿 補补 錄录 構构 數数 灘滩 島岛 爾尔 "
    "瀾澜 嵐岚 榮荣 銅铜 鉑铂 頤颐 寶宝 徑径 塢坞 蘆芦 薊蓟 櫟栎 硯砚 滄沧 臨临 雲云 雁雁 棲栖 謹谨 詳详 綿绵 閱阅 悅悦 紫紫 蘇苏"
)
#: Look-alike and sound-alike characters typed for those usual in names of housing.
_CONFUSED = (
    "圆园 宛苑 俯府 邮邸 寅寓 详祥 蓉榕 芸云 阑澜 铜桐 合和 兰蓝 清青 按安 风枫 路鹭 廷庭 择泽 羲曦 堂棠 与屿 函涵 闰润 泌沁 捂梧 阅悦 度渡 奚溪 鸦雅 "
    "央映 辰宸 琪淇 鹿麓 谨槿 州洲 幅福 呈星 壁碧 绵锦 庚康 粹翠 稼家 加嘉 华花 西栖 缩宿 嘱属 话活 夏厦 运远"
)
#: The same for the second characters of street names.
_CONFUSED_ROAD = "崖岸 弯湾 淋林 凤风 乡香 埸场 们门 度渡 俗谷 侨桥 抬台 披坡 景影 元园 阴荫 停亭 格阁 全泉 囗口 提堤"
#: Syllables of characters usual in names of housing.
_SYLLABLES = (
    "溪xi 璟jing 湖hu 岚lan 汇hui 曦xi 和he 铂bo 润run 紫zi 麓lu 鹭lu 榕rong 青qing 秀xiu 瑞rui 渡du 棠tang 锦jin 雅ya 桐tong 棣di 港gang 朗lang 栖qi 宸chen "
    "碧bi 悦yue 泽ze 月yue 观guan 沁qin 安an 远yuan 望wang 洲zhou 祥xiang 臻zhen 翠cui 听ting 澜lan 御yu 映ying 禾he 岭ling 汀ting 蓝lan 庭ting 梧wu 云yun "
    "涵han 颐yi 星xing 晨chen 枫feng 福fu 康kang 橡xiang 鹤he 槿jin 宁ning 屿yu 淇qi 华hua 新xin 金jin 龙long 凤feng 景jing 江jiang 山shan 水shui 天tian 阳yang "
    "春chun 和he 城cheng 庄zhuang 丽li 佳jia 世shi 纪ji 名ming 苑yuan 府fu 居ju 轩xuan 阁ge 湾wan 里li 园yuan 家jia 嘉jia 花hua 公gong 寓yu 大da 厦sha 村cun "
    "小xiao 区qu 邸di 号hao 院yuan 期qi"
)
FORMS = {ord(x[0]): x[1] for x in _FORMS.split()} | dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD])  # hidden characters go
CONFUSED = {ord(x[0]): x[1] for x in _CONFUSED.split()}
CONFUSED_ROAD = {ord(x[0]): x[1] for x in _CONFUSED_ROAD.split()}
SYLLABLES = {x[0]: x[1:] for x in _SYLLABLES.split()}
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
#: A number written in digits or Chinese numerals.
NUM = r"(?:\d+|[零〇一二两三四五六七八九十百]+)"


_FOLDED = frozenset(map(chr, FORMS))


def fold(text: str) -> str:
    """Usual widths and forms, lower case, without hidden characters."""
    t = unicodedata.normalize("NFKC", text)
    return (t if _FOLDED.isdisjoint(t) else t.translate(FORMS)).lower()


def number(text: str) -> int | None:
    """The value of digits, Chinese numerals (up to 999 in tens and hundreds, or digit by digit) or a Roman numeral."""
    if text.isdigit():
        return int(text)
    if text in _ROMAN:
        return _ROMAN[text]
    if not text:
        return None
    if not set(text) & {"十", "百"}:
        return int("".join(str(_DIGITS[c]) for c in text)) if all(c in _DIGITS for c in text) else None
    total, now = 0, None
    for c in text:
        if c in _DIGITS:
            now = _DIGITS[c]
        elif c in "十百":
            total += (1 if now is None else now) * (10 if c == "十" else 100)
            now = None
        else:
            return None
    return total + (now or 0)


def syllables(text: str) -> list[str]:
    """The syllable of each character, or the character where it has none here."""
    return [SYLLABLES.get(c, c) for c in text]


def split_latin(text: str, known: frozenset[str], most: int = 6) -> list[str] | None:
    """Latin letters without marks cut into known syllables, fewest first; null if they can't be."""
    best: list[list[str] | None] = [None] * (len(text) + 1)
    best[0] = []
    for i in range(len(text)):
        if best[i] is None or len(best[i]) >= most:
            continue
        for j in range(i + 1, min(len(text), i + 6) + 1):
            if text[i:j] in known and (best[j] is None or len(best[j]) > len(best[i]) + 1):
                best[j] = [*best[i], text[i:j]]
    return best[-1]
