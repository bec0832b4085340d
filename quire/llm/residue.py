"""Template residue, filler, error pages and script notices that stand where content should.

Every text is a message whose variable parts (numbers, references) are masked. Messages of one masked skeleton are
grouped first; skeletons then fall through a fixed-depth prefix tree, by their number of tokens and their first
``DEPTH`` tokens. In a leaf the skeletons are cut into ``SEGMENTS`` equal parts; a part that most of the leaf's skeletons
have is constant, any other is a slot, and where at least half of the parts are constant the leaf's skeletons merge to
templates with slots. All of it is grouping and counting, so that a leaf of any size stays distributed.

Each template is classified once, by evidence: how many records it fills whole (``SPREAD`` or more, with one and the same
message unless it holds a seed word, make it boilerplate), and the log odds of its pairs of neighbouring tokens. The odds are fitted on at most ``FIT`` templates a side: the
``EXAMPLES`` and the corpus's own boilerplate that resembles them against templates that fill one record only. So a
wording that recurs is found though no list has it, and prose that speaks of errors is not, though it holds their words.
The verdict goes back to the records by a join. Apart from that, slots left unresolved inside ordinary sentences are
looked for in every record.

Defined results
* null, empty and blank fields, and fields of invisible characters only, are no cases;
* the filled default label (``Page 3 of <title>``) is no case, an unfilled one is;
* prose that speaks of errors, templates or scripts is no case: a residue message has to fill its field, apart from
  quote marks and a leading label such as ``Summary:``; it may be of any length;
* a message that neither recurs nor holds a ``SEEDS`` word is no case, unless it repeats itself or is nonsense Latin;
* braces that hold single capitals, lists or JSON, and bracketed numbers, are no slots;
* rows of one id count once, if any of its texts is a case; texts of any length are read whole;
* empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.tables import cut, near, text_key

#: Levels of the prefix tree below the token count, and the parts that skeletons of a leaf are compared by.
DEPTH, SEGMENTS = 4, 16
#: Records that a template of boilerplate fills at least, and the templates of each side that the odds are fitted on.
SPREAD, FIT = 3, 2_000
#: The share of messages a pair stands in at least, the odds of a pair that the fit has not seen, and the least sum of
#: boilerplate and of others.
SMOOTH, UNSEEN, LEAST_SPREAD, LEAST_ALONE = 1e-4, -0.6, -4.0, 6.0

#: The ways a slot is written. Names have two characters or more: single
#: letters are set notation, and a value after a quoted name is JSON.
SLOT = "|".join([
    r"\{\{\s*[\p{L}_][^{}]{0,80}\}\}",
    r"\$\{\s*[\p{L}_][^{}]{0,60}\}",
    r"(?<![{\"]|\":|\":\s)\{(?:\p{Ll}|_|\p{Lo})[\p{L}\p{N}_. ]{1,40}\}",
    r"<%=?[^<>%]{1,60}%>",
    r"%\([\p{L}\p{N}_.]{1,40}\)[sdf]",
    r"<(?:(?:your|insert|enter|fill)\b[^<>]{0,40}|\p{IsHan}{1,12}|[A-Z]{3,}(?:[ _][A-Z]{2,})*)>",
    r"\[\[[^\[\]]{1,40}\]\]",
    r"\[(?:INSERT|ENTER|FILL|YOUR|ADD|TODO|TBD)\b[^\[\]]{0,40}\]|\[[A-Z]{2,}(?: [A-Z]{2,}){1,5}\]|\[(?:Your|Company|Client|Customer|Product|Project|Author|Insert|Enter) [A-Z][a-z]+(?: [A-Z][a-z]+)*\]",
    r"[【〈](?:此处|请|待)?(?:填写|输入|补充|填入|插入)[^】〉]{0,20}[】〉]|[【〈](?:此处|请)[^】〉]{1,20}[】〉]|[〔\[（(](?:此处|请|待)(?:填写|输入|补充|填入|插入)[^〕\]）)]{0,20}[〕\]）)]",
    r"@@[A-Z][A-Z0-9_]*@@",
    r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__",
    r"#\p{IsHan}{2,10}#",
    r"_{3,}",
    r"(?<![A-Za-z0-9-])X{2,}(?![A-Za-z0-9]|-\d)",
    r"×{2,}",
])

#: What every text with such a slot holds one of, for a plain search.
SLOT_MARKS = ["{", "<", "%(", "[", "【", "〈", "@@", "__", "#", "XX", "××", *(b + w for b in "〔（(" for w in ("此处", "请", "待"))]

#: Characters that are not seen.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"

#: The words of nonsense Latin.
LOREM = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi "
    "aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit "
    "anim id est laborum consec tetur porta vitae nec vel ac at mauris donec integer".split()
)

#: One of its words that stand in no other language, which it holds at least.
MARKED = r"(?<![a-z])(?=[liadtmnecv])(?:lorem|ipsum|dolore?|amet|tempor|magna|aliqua|nulla|consec|consectetur|tetur|elit|adipiscing|eiusmod|labore|veniam|nostrud)(?![a-z])"

#: Words that make a message worth scoring although it does not recur, by class, Latin ones and others.
SEEDS = {
    "error": ("not found|denied|forbidden|unauthorized|unavailable|time-?d? ?out|expired|went wrong|could ?n[o']t|cannot|can't|unable|failed|failure|errors?\\b|gateway|oops|traceback", "错误|失败|超时|不存在|已被删除|找不到|无法|权限|过期|失效|繁忙|异常|维护中|出错"),
    "script": ("javascript|noscript|scripts?\\b|scripting|cookies|browser", "脚本|浏览器"),
    "filler": ("(?:tbd|tba|todo|fixme|placeholder|dummy|sample|filler|click|insert|enter|xx+|asdf|qwer|blah|foo)\\b|xx公司", "待补充|待定|待填|待完善|待更新|暂缺|占位|示例|样例|填充|此处|这里|单击|点击"),
}


def _one_of(characters: set[str], few: int = 8) -> str:
    """A pattern of one of some characters; a look at the range of every ``few`` spares most places the test of each."""
    order = sorted(characters)
    groups = [order[i : i + few] for i in range(0, len(order), few)]
    return "[" + "".join(f"[{g[0]}-{g[-1]}&&[{''.join(g)}]]" for g in groups) + "]"


def _seeded(*classes: str) -> str:
    """The pattern of some classes' words; a look at the first character spares most places the words."""
    latin, other = ("|".join(SEEDS[c][k] for c in classes) for k in range(2))
    return f"(?<![a-z])(?=[a-z])(?:{latin})|(?={_one_of({w[0] for w in other.split('|')})})(?:{other})"


#: Labelled messages that the fit begins with.
EXAMPLES = [
    "∗ not found", "http ∗ bad gateway", "error ∗: unexpected response", "∗ internal server error", "∗ forbidden", "access denied.", "permission denied.", "your session has expired. please sign in again.", "service temporarily unavailable",
    "gateway timeout", "request timed out after ∗ s", "connection refused", "connection reset by peer", "page not found", "the requested url was not found on this server.", "this page could not be loaded.", "this content is no longer available.",
    "something went wrong. try again later.", "oops! an error occurred.", "unable to load the page.", "failed to fetch content.", "traceback (most recent call last): keyerror: 'page'", "加载失败，错误码∗", "网关错误 ∗", "服务器内部错误（∗）", "系统繁忙，请稍后再试", "请求超时，请刷新页面", "连接超时",
    "页面不存在或已被删除", "抱歉，您访问的页面不存在", "抱歉，您访问的内容找不到了", "您没有访问权限，请重新登录", "会话已过期，请返回首页", "网络异常，请稍后重试", "系统维护中", "无法访问该页面", "please enable javascript to view this page.", "you need to turn on scripts in your browser to continue.",
    "this site requires javascript and cookies.", "checking your browser before access.", "your browser does not support javascript.", "noscript: content is hidden", "javascript is disabled in your browser.", "scripts must be allowed.", "请开启脚本功能后继续浏览", "检测到脚本被禁用，内容无法显示", "您的浏览器不支持javascript，请启用后重试",
    "本页面需要启用 javascript 才能显示", "（待补充）", "待定", "内容待补充", "单击此处添加文本", "点击此处输入标题", "请在此处输入正文", "这里是示例文字，请替换。", "示例段落，仅用于排版测试。", "此段为排版占位，无实际内容。", "xx公司xxxx年第∗页内容待补充", "xx company reached xx units", "tbd: summary to follow", "tbd", "todo",
    "click to add text", "enter summary here", "insert title here", "dummy paragraph. replace before release.", "placeholder text", "sample text", "asdf asdf qwer", "blah blah",
]
#: Messages that repeat one word, one stretch of characters, or a row of keys.
REPEATS = r"(?:(?:asdf|qwer|qwerty|zxcv|hjkl|jkl|foo|bar|baz|blah|test|testing|sample|dummy|text|xxx|abc|aaa)[ .,]*)+|(?<words>.{1,10}?)\s?(?:\k<words>\s?){2,}|(?<run>[\p{IsHan}\w]{1,12})\k<run>+|(?:一二三四五六七八九十)+|abcdefg\w*|1234567890|0123456789"
_END = r"[.。!！…~ ]*"

#: A label or quote mark that stands before the message, and the filled default label.
LABEL = r"^(?:(?:>|[-*•]|#{1,6})\s+|(?:摘要|概要|总结|内容|正文|summary|abstract|content|note)\s*[:：]\s*)+"
DEFAULT = r"^page ∗ of .+$"


def _holds(text: Column, words: Iterable[str]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def visible(text: Column) -> Column:
    """The text without invisible characters."""
    return F.when(_holds(text, INVISIBLE), F.regexp_replace(text, f"[{INVISIBLE}]", "")).otherwise(text)


def cleaned(plain: Column) -> Column:
    """The message of a visible text: without labels and quote marks, white space collapsed, letters lower."""
    return F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), "(?i)" + LABEL, "")))


def masked(message: Column) -> Column:
    """The skeleton of a message: references and numbers become one mark."""
    references = F.regexp_replace(message, r"(?<![0-9a-z])(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![0-9a-z])", "∗")
    return F.regexp_replace(F.when(message.rlike("[0-9a-f]{6}"), references).otherwise(message), r"\d+(?:[.,]\d+)*", "∗")


def tokens_of(skeleton: Column) -> Column:
    """Latin words, masks, and every other character that is no space."""
    return F.regexp_extract_all(skeleton, F.lit(r"([a-z_']+|∗|[^\sa-z])"), 1)


def has_slot(plain: Column) -> Column:
    """Whether a slot was left unresolved anywhere in a visible text."""
    return _holds(plain, SLOT_MARKS) & plain.rlike("(?m)" + SLOT)


def skeletons(records: DataFrame) -> DataFrame:
    """``(record_kind, record_id, slot, same, s1, s2, skeleton)`` of every record, whose patterns are sought once.

    ``slot``: whether it has a slot; ``same``: a key of its message; ``s1``, ``s2``: the 128-bit key of its skeleton, which
    is empty where there is no message. Each step names the one before several times, so none is merged into the next.
    """
    plain = records.select("record_kind", "record_id", visible(F.col("text")).alias("plain"))
    message = plain.select("record_kind", "record_id", has_slot(F.col("plain")).alias("slot"), cleaned(F.col("plain")).alias("message"))
    skeleton = message.select("record_kind", "record_id", "slot", F.xxhash64("message").alias("same"), masked(F.col("message")).alias("skeleton"))
    keyed = skeleton.select("record_kind", "record_id", "slot", "same", "skeleton", text_key(F.col("skeleton")).alias("key"))
    return cut(keyed.select("record_kind", "record_id", "slot", "same", F.col("key.h1").alias("s1"), F.col("key.h2").alias("s2"), "skeleton"))


def placed_skeletons(messages: DataFrame) -> DataFrame:
    """Every skeleton once, with its leaf in the tree; behind a checkpoint.

    ``(s1, s2, n, recurs, skeleton, class, itself, leaf)``; ``recurs``: one and the same message of it fills ``SPREAD`` records or more.
    """
    per = messages.where("skeleton != ''").groupBy("s1", "s2").agg(F.first("skeleton").alias("skeleton"), (F.min("same") == F.max("same")).alias("fixed"), F.count("*").alias("n"))
    text = F.col("skeleton")
    size = F.length(F.replace(F.regexp_replace(text, r"[a-z_']{2,}", "w"), F.lit(" "), F.lit("")))
    first = F.regexp_extract(text, rf"^(?:\s*(?:[a-z_']+|∗|[^\sa-z])){{0,{DEPTH}}}", 0)
    return cut(per.select("s1", "s2", "n", (F.col("fixed") & (F.col("n") >= SPREAD)).alias("recurs"), "skeleton", seed_class(text).alias("class"), fills_itself(text).alias("itself"), F.xxhash64(size, first).alias("leaf")))


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _parts(tokens: Column) -> Column:
    """The hashes of ``SEGMENTS`` equal parts of a skeleton, a token at least each."""
    many = F.greatest(F.lit(1), F.least(F.lit(SEGMENTS), F.size(tokens)))
    at = lambda i: F.floor(i * F.size(tokens) / many).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.xxhash64(F.slice(tokens, at(i) + 1, at(i + 1) - at(i))))


def mined_templates(placed: DataFrame) -> DataFrame:
    """``(s1, s2, template, n_records)``: the template that every skeleton merges into, by its key, and how many records that fills."""
    shared = cut(placed.groupBy("leaf").agg(F.count("*").alias("leaf_size")).where("leaf_size > 1"))
    several = near(placed.select("leaf", "s1", "s2", "skeleton"), shared, "leaf").select("leaf", "s1", "s2", _once(tokens_of(F.col("skeleton")), _parts).alias("parts"))
    spread = several.join(shared, "leaf").select("leaf", "s1", "s2", "leaf_size", F.posexplode("parts").alias("at", "part"))
    constant = spread.groupBy("leaf", "at", "part").agg(F.count("*").alias("n"), F.first("leaf_size").alias("size")).where("2 * n > size").select("leaf", "at", "part", F.lit(True).alias("constant"))
    marked = spread.join(constant, ["leaf", "at", "part"], "left")
    kept = F.when(F.col("constant"), F.xxhash64("at", "part")).otherwise(F.xxhash64("at"))
    merged = marked.groupBy("s1", "s2", "leaf").agg(F.count("constant").alias("k"), F.count("*").alias("of"), F.bit_xor(kept).alias("shape")).where("2 * k >= of").select("s1", "s2", F.xxhash64("leaf", "shape").alias("merged"))
    named = placed.select("s1", "s2", "n").join(merged, ["s1", "s2"], "left").select("s1", "s2", "n", F.when(F.col("merged").isNotNull(), F.struct(F.col("merged").alias("t1"), F.lit(0).cast("long").alias("t2"))).otherwise(F.struct(F.col("s1").alias("t1"), F.col("s2").alias("t2"))).alias("template"))
    return named.join(named.groupBy("template").agg(F.sum("n").alias("n_records")), "template").select("s1", "s2", "template", "n_records")


def seed_class(skeleton: Column) -> Column:
    """The first class one of whose seed words stands in the text, else null."""
    return F.when(skeleton.rlike(_seeded(*SEEDS)), F.coalesce(*(F.when(skeleton.rlike(_seeded(name)), name) for name in SEEDS)))


def fills_itself(skeleton: Column) -> Column:
    """Whether a message only repeats itself, or is nonsense Latin."""
    words = F.regexp_extract_all(skeleton, F.lit(r"([a-z]+)"), 1)
    latin = F.size(F.filter(words, lambda w: w.isin(*sorted(LOREM))))
    lorem = F.when(skeleton.rlike(MARKED), (F.size(words) >= 3) & (latin >= 0.7 * F.size(words)) & ~skeleton.rlike(r"\p{IsHan}")).otherwise(False)
    return lorem | skeleton.rlike(rf"(?s)^(?:{REPEATS}){_END}$")


def _pairs(tokens: Column) -> Column:
    ends = F.concat(F.array(F.lit("^")), tokens, F.array(F.lit("$")))
    return _once(ends, lambda e: F.array_distinct(F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: F.concat_ws(" ", a, b))))


def _odds(good: DataFrame, bad: DataFrame, spark) -> DataFrame:
    """``(pair, odds)`` of the pairs of neighbouring tokens in two small sets ``(skeleton)``; both have ``FIT`` rows at most."""
    examples = spark.createDataFrame([(e,) for e in EXAMPLES], "skeleton string")
    residue = good.select("skeleton").unionByName(examples)
    sides = [side.select(F.explode(_pairs(tokens_of(F.col("skeleton")))).alias("pair"), F.lit(k).alias("k")) for k, side in enumerate((bad.select("skeleton"), residue))]
    counts = reduce(DataFrame.unionByName, sides).groupBy("pair").agg(F.count_if(F.col("k") == 1).alias("good"), F.count_if(F.col("k") == 0).alias("bad"))
    n_good, n_bad = F.lit(max(1, residue.count())), F.lit(max(1, bad.count()))
    return counts.select("pair", F.round(F.log(F.col("good") / n_good + SMOOTH) - F.log(F.col("bad") / n_bad + SMOOTH), 9).alias("odds"))


def _scored(candidates: DataFrame, odds: DataFrame) -> DataFrame:
    """Candidates with ``score``, the sum of the odds of their pairs; pairs the fit has not seen count only where they fill too few records."""
    pairs = candidates.select("s1", "s2", "n_records", F.explode(_pairs(tokens_of(F.col("skeleton")))).alias("pair"))
    unseen = F.when(F.col("n_records") >= SPREAD, 0.0).otherwise(UNSEEN)
    sums = pairs.join(F.broadcast(odds), "pair", "left").groupBy("s1", "s2").agg(F.round(F.sum(F.coalesce("odds", unseen)), 6).alias("score"))  # the odds come of FIT templates a side
    return candidates.join(sums, ["s1", "s2"])


def classified_templates(messages: DataFrame) -> DataFrame:
    """``(s1, s2, template, skeleton, n_records, score, verdict)`` of the skeletons whose template is residue."""
    spark = messages.sparkSession
    placed = placed_skeletons(messages)
    text = F.col("skeleton")
    default = text.rlike(DEFAULT) & ~text.rlike(SLOT)
    wanted = placed.select("s1", "s2", "recurs", "skeleton", "class", "itself").where((F.col("recurs") | F.col("class").isNotNull() | F.col("itself")) & ~default)
    candidates = cut(wanted.join(mined_templates(placed), ["s1", "s2"]))
    some = lambda df, *order: df.orderBy(*order).limit(FIT)
    prose = cut(some(placed.where((F.col("n") < SPREAD) & (F.col("class").isNull() | text.rlike(DEFAULT))).select("skeleton"), F.xxhash64("skeleton"), "skeleton"))
    nothing = spark.createDataFrame([], "skeleton string")
    first = _scored(candidates.where((F.col("n_records") >= SPREAD) & F.col("class").isNotNull()), _odds(nothing, prose, spark))
    like = cut(some(first.where(F.col("score") >= LEAST_ALONE).select("skeleton", "n_records"), F.desc("n_records"), "skeleton").select("skeleton"))
    least = F.when(F.col("n_records") >= SPREAD, LEAST_SPREAD).otherwise(LEAST_ALONE)
    scored = _scored(candidates, _odds(like, prose, spark)).where(F.col("itself") | (F.col("score") >= least))
    return scored.select("s1", "s2", "template", "skeleton", "n_records", "score", F.when(F.col("itself"), "filler").otherwise(F.coalesce("class", F.lit("boilerplate"))).alias("verdict"))


def residue_records(records: DataFrame) -> DataFrame:
    """``(record_kind, record_id)`` of ``records (record_kind, record_id, text)`` to exclude."""
    texts = records.where(F.col("record_id").isNotNull() & F.col("text").isNotNull()).select("record_kind", "record_id", "text").distinct()
    messages = skeletons(texts)
    bad = classified_templates(messages).select("s1", "s2")
    whole = messages.where("skeleton != ''").select("record_kind", "record_id", "s1", "s2").join(bad, ["s1", "s2"], "left_semi").select("record_kind", "record_id")
    return whole.unionByName(messages.where("slot").select("record_kind", "record_id")).distinct()
