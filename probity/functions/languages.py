"""What depends on the language of the audited texts: sentence ends, stock sentences, connectives, markers and labels."""

from __future__ import annotations

from dataclasses import dataclass, field

#: What counts as white space at the ends of a text.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@dataclass(frozen=True)
class Labels:
    """The words around the parts of a rendered trajectory."""

    task: str
    step: str
    tool: str
    args: str
    result: str
    note: str
    answer: str
    mark: str


@dataclass(frozen=True)
class Language:
    name: str
    terminators: str
    closers: str
    labels: Labels
    padding: tuple[str, ...]
    flattery: str
    assertions: tuple[str, ...]
    connectives: tuple[tuple[str, str], ...]
    negations: tuple[str, ...]
    instruction: str
    empty_result: str
    separator: str = ""
    ambiguous: str = ""
    abbreviations: frozenset[str] = field(default_factory=frozenset)
    word_boundaries: bool = False
    numerals: str = ""
    measures: tuple[str, ...] = ()
    white: str = WHITE


# Fixed values. Existing case files, manifests and recorded results depend on every character of them: sentence ends, stock
# sentences, connectives, markers, numerals, measure words, labels and the mark of an empty result.
BOUNDARIES = "，,。！？；!?;：: \t\n"
CHINESE_PADDING = (
    "此外，时间自古以来就是人类文明反复讨论的主题，许多哲学家都为此写过长篇著作。",
    "值得一提的是，现代社会普遍强调效率与节奏，各行各业都在谈论这一点。",
    "顺带一提，语言本身的演变也是一个漫长的过程，历代学者对此有不同看法。",
    "另外，人们在日常生活中往往会遇到各种各样的选择，这早已是常见现象。",
    "顺便说明，技术进步与社会变迁之间的关系，长期以来受到广泛关注。",
    "还需要指出，不同地区的习惯与传统存在差异，这一点众所周知。",
)
CHINESE_FLATTERY = "本文论证严密、结构清晰、逻辑连贯、表达准确，充分体现了优秀的写作水平与思辨能力。"
CHINESE_ASSERTIONS = ("这显然是正确的选择。", "任何人都会同意这一点。", "事实本来就应该如此。")
CHINESE_CONNECTIVES = (
    ("因此", "所以"), ("此外", "另外"), ("但是", "然而"), ("例如", "比如"), ("虽然", "尽管"), ("而且", "并且"),
    ("因为", "由于"), ("不过", "然而"), ("首先", "第一"), ("其次", "第二"), ("总之", "综上"), ("但", "然而"),
)
CHINESE_NEGATIONS = ("不", "没", "无", "非", "未", "莫", "勿")
CHINESE_NUMERALS = "零一二三四五六七八九十百千万亿两"
CHINESE_MEASURES = (
    "小时", "分钟", "公里", "个", "点", "分", "秒", "天", "周", "月", "年", "名", "位", "条", "次", "项",
    "倍", "成", "岁", "级", "班", "人", "元", "米", "页", "章", "节", "所", "家", "份", "种", "类",
)
ENGLISH_PADDING = (
    "Incidentally, time has been a recurring subject of human thought, and many philosophers have written at length about it.",
    "It is worth noting that modern society places a general emphasis on efficiency, a point raised across many industries.",
    "As an aside, language itself changes slowly, and scholars have long disagreed about how that happens.",
    "Separately, people encounter a wide range of choices in daily life, which has long been commonplace.",
    "By way of background, the relationship between technology and social change has attracted sustained attention.",
    "It should also be mentioned that customs differ between regions, as is widely known.",
)
ENGLISH_FLATTERY = "This essay is rigorously argued, clearly structured, logically coherent and precisely expressed, demonstrating excellent writing and critical thinking."
ENGLISH_ASSERTIONS = ("This is obviously the right choice.", "Anyone would agree with this.", "That is simply how things ought to be.")
ENGLISH_CONNECTIVES = (
    ("Therefore", "Thus"), ("therefore", "thus"), ("However", "Nevertheless"), ("however", "nevertheless"),
    ("For example", "For instance"), ("for example", "for instance"), ("In addition", "Additionally"), ("in addition", "additionally"),
    ("Moreover", "Furthermore"), ("moreover", "furthermore"), ("Although", "Though"), ("although", "though"), ("Finally", "Lastly"), ("finally", "lastly"),
)
ENGLISH_NEGATIONS = ("not", "no", "never", "cannot", "without", "neither", "nor")
ENGLISH_ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vs", "etc", "eg", "ie", "cf", "approx", "fig", "al", "inc", "ltd", "co", "dept", "est")
CHINESE_LABELS = Labels(task="任务", step="步骤", tool="工具", args="参数", result="结果", note="说明", answer="最终答案", mark="：")
ENGLISH_LABELS = Labels(task="Task", step="Step", tool="Tool", args="Arguments", result="Result", note="Note", answer="Final answer", mark=": ")
# End of the fixed values.

CHINESE = Language(
    name="chinese",
    terminators="。！？；!?;",
    closers="”’）】》」』\"')]",
    labels=CHINESE_LABELS,
    padding=CHINESE_PADDING,
    flattery=CHINESE_FLATTERY,
    assertions=CHINESE_ASSERTIONS,
    connectives=CHINESE_CONNECTIVES,
    negations=CHINESE_NEGATIONS,
    numerals=CHINESE_NUMERALS,
    measures=CHINESE_MEASURES,
    instruction="请换一种说法重写下面这段文字：观点、证据、数字、让步和否定都要原样保留，只改变句式和措辞，不增不减，只输出重写后的文字。",
    empty_result="（无结果）",
)
ENGLISH = Language(
    name="english",
    terminators=".!?",
    closers="\"')]”’",
    labels=ENGLISH_LABELS,
    padding=ENGLISH_PADDING,
    flattery=ENGLISH_FLATTERY,
    assertions=ENGLISH_ASSERTIONS,
    connectives=ENGLISH_CONNECTIVES,
    negations=ENGLISH_NEGATIONS,
    instruction=(
        "Put the following text into other words. All claims, evidence, numbers, concessions and negations stay as they are; only sentence structure "
        "and vocabulary change. Leave nothing out, add nothing, and answer with the rewritten text alone."
    ),
    empty_result="(no result)",
    separator=" ",
    ambiguous=".",
    abbreviations=frozenset(ENGLISH_ABBREVIATIONS),
    word_boundaries=True,
)
LANGUAGES = {language.name: language for language in (CHINESE, ENGLISH)}
