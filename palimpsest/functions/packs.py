"""Language packs: the marks and word lists that text operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LanguagePack:
    """Sentence ends, quotes, heading pattern and lexicons of a language; operators accept any pack."""

    terminators: str
    quotes: tuple[tuple[str, str], ...]
    heading: str
    connectives: dict[str, tuple[str, ...]] = field(default_factory=dict)
    templates: dict[str, tuple[str, ...]] = field(default_factory=dict)
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    dense: tuple[str, ...] = ()
    calm: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()
    genres: dict[str, dict[str, int]] = field(default_factory=dict)


# The default pack for Chinese fiction and the English texts beside it.
NOVEL = LanguagePack(
    terminators="。！？!?；;",
    quotes=(("“", "”"), ("「", "」"), ("‘", "’")),
    heading="第[0-9零一二三四五六七八九十百千万〇]+[章节回卷部集话話]",
    connectives={
        "cause": ("因为", "因此", "所以", "由于", "because"),
        "turn": ("却", "但是", "然而", "虽然", "although"),
        "condition": ("如果", "若不是", "只要", "除非", "unless"),
        "sequence": ("然后", "随后", "终于", "之后", "then"),
        "parallel": ("同时", "一边", "又", "and"),
    },
    templates={
        "surprise": ("满座顿时没了声音", "孩子们吓得躲进柜子", "押注的人输得精光"),
        "omen": ("那盏灯也随之熄灭", "猎犬忽然不再吠叫", "河水竟倒流了半刻"),
        "manner": ("冷着脸", "含着泪", "咬着牙", "不动声色", "瞒着众人"),
    },
    positive=("重逢", "思念", "松了口气", "定亲", "笑着", "守住", "还清", "forgive", "kept"),
    negative=("争执不下", "失控", "失守", "圈套", "冷笑", "猜忌", "逼退", "细作", "吓得", "quarrelled", "burned", "lost"),
    dense=("失控", "突破", "悬赏", "立誓", "试探", "封住", "lost", "swore", "refused"),
    calm=("磨墨写信", "煎第三副药", "烤火取暖", "听人吹笛", "装睡", "dreamed", "waited"),
    negations=("不", "没", "未", "not", "never"),
    genres={
        "martial": {"剑法": 4, "心诀": 3, "掌": 2, "突破": 3, "追兵": 2},
        "intrigue": {"细作": 4, "试探": 3, "悬赏": 3, "密": 1, "圈套": 2},
        "romance": {"思念": 4, "重逢": 3, "定亲": 3, "牵住": 2, "嫁衣": 2},
        "mystery": {"碎成": 2, "埋着": 3, "失踪多年": 3, "调包": 4, "turned out": 3},
        "gothic": {"lighthouse": 3, "crypt": 4, "midnight": 2, "storm": 2, "drowned": 2},
    },
)
