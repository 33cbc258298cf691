"""Rule scoring: gates, then additive rules, in one select of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.text import cjk_ratio, hits, hits_in_lower, utf16_length
from siftloom.functions.vocab import Vocabulary


@dataclass(frozen=True)
class RuleSet:
    """Everything that a score depends on. Patterns are regular expressions, markers are plain needles."""

    tools: Vocabulary = Vocabulary()
    topics: Vocabulary = Vocabulary()
    soft: tuple[str, ...] = ()
    experience: tuple[str, ...] = ()
    promo: tuple[str, ...] = ()
    news: tuple[str, ...] = ()
    academic: tuple[str, ...] = ()
    min_script: float = 0.15
    script_ratio: object = field(default=cjk_ratio, hash=False)
    job_title: str = "(?!)"
    job_role: str = "(?!)"
    job_pay: str = "(?!)"
    job_headings: tuple[str, ...] = ()
    hard_promo: str = "(?!)"
    first_person: str = "(?!)"
    question: str = "[?？]\\s*$"
    self_promo: str = "(?!)"
    coach_promo: str = "(?!)"
    machine_report: str = "(?!)"
    listicle_headings: tuple[str, ...] = ()
    serial_title: str = "(?!)"
    threshold: int = 6


#: What the titles and bodies of Han texts are judged by.
HAN_PATTERNS = {
    "first_person": "我(?:们|們)?(?:又|也|终于|終於|花了|用了)?[把让讓用写做搭配试折玩换踩弄跑改造建]",
    "question": "(求助|求教|请教|請教|求推荐|求推薦|怎么办|怎麼辦|如何解决|如何解決|有没有人|有沒有人|有大佬|求解|咨询一下|諮詢一下)|[?？]\\s*$",
    "job_title": (
        "(\\d+\\s*[kK]\\s*[-–~]\\s*\\d+\\s*[kK])|(\\d+\\s*[wW]\\s*[-–~]\\s*\\d+\\s*[wW])|(薪资|月薪|年薪|五险一金|双休|base\\s|内推|投递简历|远程全职|全职远程|招聘|诚聘|急招|急聘|直招|热招|诚招|招人|可接|接私活|承接外包|求职|找工作|年经验[｜|])"
        "|(招[\\s\\S]{0,24}?(全栈|前端|后端|客户端|服务端|算法|架构师|工程师|开发者?|运维|测试|产品经理|设计师|实习生?))"
    ),
    "job_role": "(全栈|前端|后端|客户端|服务端|算法|架构师|工程师|技术专家|开发者|运维|测试|产品经理|设计师|实习生)",
    "job_pay": "\\d+\\s*[-–~]\\s*\\d+\\s*[kKwW](?![a-zA-Z])",
    "hard_promo": "(拼车|中转|白嫖|代充|合租|车队|上车|开车|\\d+\\s*人车|[一二两三四五六七八九十]人车|共享账号|批发|一键注册|免费领|折起)",
    "self_promo": (
        "(求个?\\s*[Ss]tar|求\\s*star|欢迎\\s*[Ss]tar|歡迎\\s*[Ss]tar|点个\\s*[Ss]tar|點個\\s*[Ss]tar|给个\\s*[Ss]tar|欢迎试用|欢迎体验|欢迎大家|欢迎大佬|欢迎拍砖|歡迎拍磚|请大家锐评|锐评一下|銳評一下|提提意见|提点意见|提提建議|求交流|求反馈|求建议|"
        "开发者自荐|送会员|注册免费|免费体验|欢迎来|敬请期待|已上线|新版本发布|上线啦|来压测|\\[分享开源项目\\]|[\\[【](分享创造|分享創造|开源|開源)[\\]】]|开源一个|开源了一个|重磅开源|开源发布|開源發布|核心功能有|主要功能有|功能特性[:：]|在线体验[:：]|立即体验|"
        "歡迎試用|歡迎體驗|歡迎大家|求回饋|開發者自薦|送會員|註冊免費|免費體驗|歡迎來|敬請期待|新版本發布|上線啦|開源一個|開源了一個|重磅開源|線上體驗[:：]|立即體驗)"
    ),
    "coach_promo": "(賦能師|賦能教練|AI\\s*賦能|我的學員|帶學員|輔導超過|實戰工作坊|一日工作坊|微型創業|贖回.{0,4}(時間|小時)|歡迎按愛心|按愛心|收藏並分享)",
    "serial_title": "(^\\s*第\\s*\\d+\\s*[章篇讲课]|^\\s*[Dd][Aa][Yy]\\s*\\d+|系列教程|系列文章第)",
    "machine_report": "(本文未执行|本文基于[^。]{0,40}(源码|原始碼)快照|本文结论类型|未执行项目构建|静态(扫描|观察)得到)",
}
#: What each of the many wordings of self_promo begins with. They are tried only there.
HAN_SELF_PROMO_STARTS = "求欢歡点點给请銳锐提开送注免敬已新上来[【重開核主功在立線註"
#: Headings of job descriptions and of tool lists.
HAN_JOB_HEADINGS = ("岗位职责|崗位職責", "任职要求|任職要求", "职位描述|職位描述", "岗位要求|崗位要求", "投递简历|投遞履歷|简历投递|履歷投遞", "薪资范围|薪資範圍", "福利待遇")
HAN_LISTICLE_HEADINGS = ("适合谁\\s*[:：]|適合誰\\s*[:：]", "解决什么问题\\s*[:：]|解決什麼問題\\s*[:：]", "核心能力\\s*[:：]", "使用边界\\s*[:：]|使用邊界\\s*[:：]", "实际场景\\s*[:：]|實際場景\\s*[:：]", "适用人群\\s*[:：]|適用人群\\s*[:：]", "更新日期\\s*[:：]", "维度对比|維度對比")
#: Words that speak for a text about agents, for experience, and against it.
HAN_SOFT = ("ai 编程", "ai编程", "ai coding", "智能体", "编程助手", "代码助手", "智能编码", "coding agent", "agentic", "ai agent", "编程 agent", "自动编程", "人机协作编程")
HAN_EXPERIENCE = (
    "折腾", "踩坑", "避坑", "实测", "试用", "体验", "心得", "记录", "手记", "日志", "实践", "复盘", "总结", "教训", "翻车", "真香", "上手", "入门到", "从零", "我的", "我用", "我把", "我们把", "自己", "亲测", "玩了", "搞定", "折磨",
    "工作流", "配置", "定制", "魔改", "自建", "搭建", "迁移", "替换", "对比", "一周", "一个月", "三天", "半年", "天后", "小时", "花了", "为什么我", "怎么用", "如何用", "这样用", "用法", "姿势", "骚操作", "踩了", "坑", "心路", "感受", "吐槽", "安利", "劝退",
    "折騰", "實測", "試用", "體驗", "記錄", "手記", "實踐", "復盤", "總結", "教訓", "翻車", "入門到", "從零", "親測", "定製", "遷移", "替換", "對比", "一週", "一個月", "天後", "小時", "為什麼我", "怎麼用", "這樣用", "姿勢", "騷操作", "勸退",
)
HAN_NEWS = (
    "融资", "估值", "官宣", "发布会", "财报", "季度", "市值", "收购", "裁员", "榜单", "排行榜", "市场份额", "行业报告", "白皮书", "峰会", "大会召开", "受访", "据悉", "日前宣布", "正式发布", "重磅", "刷屏", "爆火",
    "融資", "發布會", "財報", "收購", "裁員", "榜單", "市場份額", "行業報告", "白皮書", "峰會", "大會召開", "受訪", "據悉", "正式發布",
)
HAN_PROMO = (
    "拼车", "中转", "白嫖", "免费额度", "车队", "代充", "优惠", "折扣", "促销", "限时", "解锁", "破解", "共享账号", "开车", "上车", "合租", "批发", "招聘", "内推", "广告", "赞助", "带货", "课程", "训练营", "报名",
    "車隊", "促銷", "限時", "共享帳號", "開車", "上車", "批發", "內推", "廣告", "贊助", "帶貨", "訓練營",
)
HAN_ACADEMIC = ("arxiv", "论文", "综述", "benchmark 结果", "数据集", "实验表明", "本文提出", "我们提出", "sota", "消融实验", "論文", "綜述", "數據集", "實驗表明", "我們提出", "消融實驗")


def han_rules(tools: Vocabulary, topics: Vocabulary) -> RuleSet:
    """The rules for Han texts about the tools and topics of a vocabulary."""
    starts = HAN_SELF_PROMO_STARTS.replace("[", "\\[")
    patterns = HAN_PATTERNS | {"self_promo": f"(?=[\\[【\u4E00-\u9FFF&&[{starts}]])(?:{HAN_PATTERNS['self_promo']})"}
    return RuleSet(tools=tools, topics=topics, soft=HAN_SOFT, experience=HAN_EXPERIENCE, promo=HAN_PROMO, news=HAN_NEWS, academic=HAN_ACADEMIC, job_headings=HAN_JOB_HEADINGS, listicle_headings=HAN_LISTICLE_HEADINGS, **patterns)


def _count(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.when(text.rlike(p), 1).otherwise(0)
    return out


def is_job_post(r: RuleSet, title: Column, body: Column) -> Column:
    return title.rlike(r.job_title) | (title.rlike(r.job_role) & title.rlike(r.job_pay)) | (_count(body, r.job_headings) >= 2)


def score_items(items: DataFrame, r: RuleSet) -> DataFrame:
    """items (title, excerpt, tail, thread, views, comments) with tools, topics, score, verdict, reasons and the gate that closed.

    The gates are tried in order and leave the score at 0; after them the rules add up, for items that no gate closed to.
    """
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = items.withColumns({"_t": s("title"), "_e": s("excerpt"), "_tail": s("tail")}).withColumns({"_b": F.concat_ws("\n", "_t", "_e"), "_et": F.concat_ws("\n", "_e", "_tail"), "_len": utf16_length(F.col("_e"))})
    df = df.withColumn("_lower", F.lower("_b"))
    df = df.withColumns({"_tt": r.tools.matches(F.col("_t")), "_tp": r.topics.matches(F.col("_t")), "tools": r.tools.matches_in_lower(F.col("_lower")), "topics": r.topics.matches_in_lower(F.col("_lower"))})
    n = lambda text, needles: F.size(hits(F.col(text), list(needles)))
    in_body = lambda needles: F.size(hits_in_lower(F.col("_lower"), list(needles)))
    df = df.withColumns({
        "_th": F.size(r.tools.scoring(F.col("_tt"))) + F.size(r.topics.scoring(F.col("_tp"))), "_ah": F.size(r.tools.scoring(F.col("tools"))) + F.size(r.topics.scoring(F.col("topics"))), "_soft": in_body(r.soft),
    })
    gate = (
        F.when((r.script_ratio(F.col("_t")) < r.min_script) & (r.script_ratio(F.col("_b")) < r.min_script), "language")
        .when(is_job_post(r, F.col("_t"), F.col("_et")), "job")
        .when(F.col("_t").rlike(r.hard_promo), "promo")
        .when((F.col("_ah") + F.col("_soft")) == 0, "no-hit")
    )
    df = df.withColumn("closed", gate)
    still = lambda value, other=0: F.when(F.col("closed").isNull(), value).otherwise(F.lit(other))
    df = df.withColumns({
        "_te": still(n("_t", r.experience)), "_be": still(n("_e", r.experience)), "_p": still(in_body(r.promo)), "_n": still(in_body(r.news)), "_a": still(in_body(r.academic)),
        "_early": still(F.concat_ws("\n", "_t", F.substring("_e", 1, 400)).rlike(r.self_promo), False),
    })
    df = df.withColumn("_end", still(~F.col("_early") & F.when(F.col("_tail") != "", F.col("_tail")).otherwise(F.substring("_e", -400, 400)).rlike(r.self_promo), False))
    thread = F.coalesce(F.col("thread"), F.lit(False))
    rules: list[tuple[str, Column, Column]] = [
        ("title-hit", F.col("_th") >= 1, 6 + F.least(F.col("_th") - 1, F.lit(2))),
        ("body-hit", (F.col("_th") == 0) & (F.col("_ah") >= 1), F.least(F.col("_ah"), F.lit(2))),
        ("soft", F.col("_soft") > 0, F.least(F.col("_soft"), F.lit(2))),
        ("first-person", F.col("_t").rlike(r.first_person), F.lit(4)),
        ("title-experience", F.col("_te") > 0, F.lit(3)),
        ("body-experience", F.col("_be") > 0, F.least(F.col("_be"), F.lit(3))),
        ("question", F.col("_t").rlike(r.question), F.lit(-3)),
        ("promo-words", F.col("_p") > 0, -4 * F.col("_p")),
        ("news-words", F.col("_n") > 0, -2 * F.col("_n")),
        ("academic-words", F.col("_a") > 0, -2 * F.col("_a")),
        ("self-promo", F.col("_early"), F.lit(-6)),
        ("self-promo-end", F.col("_end"), F.lit(-3)),
        ("coach", F.col("_b").rlike(r.coach_promo), F.lit(-6)),
        ("machine-report", F.col("_b").rlike(r.machine_report) | F.col("_tail").rlike(r.machine_report), F.lit(-6)),
        ("listicle", _count(F.col("_et"), r.listicle_headings) >= 2, F.lit(-8)),
        ("serial", F.col("_t").rlike(r.serial_title), F.when(F.col("_be") >= 4, -2).otherwise(-4)),
        ("short-thread", thread & (F.col("_len") < 600), F.lit(-3)),
        ("long-thread", thread & (F.col("_len") >= 1800), F.lit(1)),
        ("popular", (F.coalesce(F.col("views"), F.lit(0)) >= 2000) | (F.coalesce(F.col("comments"), F.lit(0)) >= 15), F.lit(1)),
    ]
    total, reasons = F.lit(0), []
    for name, when, delta in rules:
        total = total + F.when(when, delta).otherwise(0)
        reasons.append(F.when(when, F.lit(name)))
    df = df.withColumns({"score": F.when(F.col("closed").isNotNull(), 0).otherwise(total).cast("int"), "reasons": F.when(F.col("closed").isNotNull(), F.array("closed")).otherwise(F.array_compact(F.array(*reasons)))})
    df = df.withColumn("verdict", F.when(F.col("closed").isNull() & (F.col("score") >= r.threshold), "shortlist").otherwise("reject"))
    return df.drop(*[c for c in df.columns if c.startswith("_")])
