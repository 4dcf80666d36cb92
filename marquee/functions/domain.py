"""The rule set of the announcement domain."""

from __future__ import annotations

from .rules import RuleSet, SourceLabels

# The domain's word lists and labels.
WHITELIST = ("夏令营", "开放日", "推免", "接收推免生", "预推免", "免试攻读", "硕士招生", "优秀大学生", "暑期营")
PRE_WHITELIST = ("预推免", "推免", "接收推免", "接收推免生", "免试攻读", "硕士招生")
BLACKLIST = (
    "高中生", "中学", "青少年", "暑期学校", "非学历", "国际学生", "外国留学生", "合作办学", "研修班", "课程班", "英语培训班", "翻译培训", "在职", "成人", "名单公示", "面试成绩", "考核结果", "录取名单", "报到通知", "补录", "递补",
    "高招咨询",
)
EXCLUDE = (
    "名单公示", "入选名单", "面试成绩", "结业", "研修班", "课程班", "录用", "报到", "补录", "递补", "营员名单", "考核结果", "综合考核结果", "公示名单", "拟录取名单", "复试名单", "暑期学校招生简章", "写作高级研修班", "青年教师",
)
OUTBOUND = (
    "美国高校夏令营", "美国高校", "外国高校夏令营", "外国高校", "境外高校", "境外大学", "发现中国", "未来之桥",
    "共商夏令营合作", "夏令营合作事宜", "再访我院", "来访我院", "一行再访", "访问我院", "来访交流", "合作洽谈", "来院访问", "来校访问",
)
INTERNATIONAL = ("国际暑期学校", "国际暑期班", "International Summer School", "international summer school")
DOMESTIC_MARKERS = ("优秀大学生", "推免", "预推免", "接收推免", "保研", "研招")
HIGH_SCHOOL = ("高中生夏令营", "中学生夏令营", "中学夏令营", "高招咨询", "高中生", "中学生")
RECAP = ("圆满完成", "圆满落幕", "成功举办", "顺利举办", "顺利结束", "圆满举行")
FORM_HINTS = ("申请表", "推荐表", "专家推荐信", "推荐信", "登记表", "模板下载", "下载表格")
DOCUMENT_MARKS = ("招生简章", "招生通知", "报名通知", "工作通知", "实施方案", "活动方案", "活动通知")
INTENT = ("招生", "报名", "申请", "接收", "优秀大学生", "推免", "预推免", "招募", "招生简章", "招生通知", "报名通知", "校园开放日", "接收推免", "研招", "通知")
EXCELLENT = ("优营", "优秀营员", "夏令营优营", "暑期营优营", "考核优秀", "夏令营考核结果")
PRE_RESULT = ("拟录取", "名单", "通过", "考核", "复试", "录取")
PRE_CONFIRM = ("名单", "拟录取", "通过", "考核")
LAW = ("法", "法律", "法学", "国际法", "司法", "政")
LANGUAGE = ("外国语", "外语", "英语", "翻译", "文学", "法语", "德语", "日语", "俄语", "西班牙语", "朝鲜语", "阿拉伯语", "语言")
CAMP = ("夏令营", "预推免", "推免", "暑期学校", "开放日")
ENDED = ("已结束", "报名截止", "活动结束", "公示完毕")
SOURCES = SourceLabels(manual="用户补全", submit="用户提交", search="全网检索", messaging="微信公众号", forum=("保研论坛", "eeban"), official="学院官网")

DOMAIN = RuleSet(
    pre=("预推免",), result=PRE_RESULT, confirm=PRE_CONFIRM, excellent=EXCELLENT, ended=ENDED, topics=CAMP, whitelist=WHITELIST, pre_whitelist=PRE_WHITELIST, learned=(), bad_urls=(), blacklist=BLACKLIST,
    waiver=DOMESTIC_MARKERS, exclude=EXCLUDE, recap=HIGH_SCHOOL + RECAP, form_start="附件", form_hints=FORM_HINTS, document_marks=DOCUMENT_MARKS, foreign=INTERNATIONAL, outbound=OUTBOUND, camp=("夏令营",), intent=INTENT,
    activity=("活动", "举办", "开幕"), law=LAW, language=LANGUAGE,
)
