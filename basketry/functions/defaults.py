"""Default word lists and knowledge tables for Chinese case texts and prescriptions.

Everything here is a default argument: operators take any other lexicon, patterns or tables as data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.risk import RiskWords
from ..operators.text import Lexicon

# ---- fixed values: word lists, patterns, tables and weights that results depend on ----

POSITIVE = {
    "愈": 0.9, "瘥": 0.85, "安": 0.8, "除": 0.85, "已": 0.75, "立": 0.3, "即": 0.2, "神": 0.4, "良": 0.35, "桴鼓": 0.8,
    "减": 0.5, "轻": 0.45, "平": 0.55, "霍然": 0.85, "应手": 0.8, "见效": 0.55, "好转": 0.45, "起色": 0.4, "收功": 0.65,
    "投之即效": 0.85, "效如": 0.9, "立起": 0.85, "不爽": 0.3, "爽": 0.25, "颇效": 0.7, "甚效": 0.8, "大效": 0.85,
    "痊愈": 0.92, "康复": 0.85, "根治": 0.88, "全消": 0.90, "悉除": 0.88, "顿愈": 0.92, "立效": 0.85, "奇效": 0.90,
    "速效": 0.80, "显效": 0.75, "佳效": 0.72, "奏效": 0.70, "消退": 0.60, "消失": 0.70, "缓解": 0.55, "安宁": 0.60,
    "通利": 0.55, "和调": 0.50, "复常": 0.75, "安和": 0.65, "诸恙悉平": 0.85, "病去八九": 0.75, "渐入坦途": 0.65,
    "药到病除": 0.90, "覆杯即安": 0.92, "一剂知": 0.80, "有效": 0.55, "极效": 0.85, "渐平": 0.35,
}
NEGATIVE = {
    "不效": -0.8, "无效": -0.9, "未见": -0.7, "依旧": -0.6, "反增": -0.8, "不对证": -0.85, "无功": -0.75, "停用": -0.5,
    "不佳": -0.5, "时好时坏": -0.3, "缓慢": -0.2, "平平": -0.3, "反剧": -0.9, "加剧": -0.85, "恶化": -0.95,
    "不验": -0.80, "罔效": -0.85, "少效": -0.50, "微效": -0.30, "反复": -0.40, "缠绵": -0.45, "迁延": -0.40, "难愈": -0.60,
    "加重": -0.80, "不适": -0.35, "副作用": -0.50, "过敏": -0.55, "未减": -0.65, "无寸效": -0.90, "病进": -0.85, "邪陷": -0.80,
}
NEGATIONS = ["不", "未", "无", "非", "勿", "莫", "难"]
INTENSIFIERS = {"大": 1.3, "甚": 1.3, "极": 1.4, "至": 1.2, "殊": 1.2, "颇": 1.15, "极奇": 1.5, "万": 1.5, "十分": 1.3}
TIME_PATTERNS = [
    ("一剂而", 1), ("一剂知", 1), ("覆杯", 0.5), ("立", 0.1), ("一日", 1), ("三日", 3), ("五剂", 5), ("五日", 5), ("七日", 7),
    ("旬日", 10), ("半月", 15), ("两周", 14), ("月余", 30), ("经年", 365), ("二剂", 2), ("三剂", 3), ("四剂", 4), ("六剂", 6),
    ("十剂", 10), ("廿剂", 20), ("二日", 2), ("四日", 4), ("六日", 6), ("八日", 8), ("十日", 10), ("数日", 5), ("数周", 21),
    ("数月", 90), ("即[日刻时]", 0.5), ("旋即", 0.2), ("须臾", 0.1), ("俄顷", 0.15), ("少顷", 0.2), ("食顷", 0.5),
]
REACTION_PATTERNS = [
    ("(恶心|呕吐|吐逆|呕逆)", "胃肠道反应", "轻度"), ("(腹痛|腹胀|泄泻|下利|便溏)", "胃肠道反应", "轻度"),
    ("(口舌麻木|四肢麻木|麻木)", "神经系统", "中度"), ("(头晕|眩晕|头眩|昏冒)", "神经系统", "轻度"),
    ("(心悸|心慌|怔忡|心律失常)", "心脏毒性", "中度"), ("(胸闷|胸痛|气短|气促)", "呼吸系统", "中度"),
    ("(皮疹|瘙痒|红斑|风团|紫癜)", "过敏反应", "轻度"), ("(水肿|浮肿|肿胀)", "水钠潴留", "中度"),
    ("(黄疸|肝损|肝酶|ALT|AST)", "肝脏毒性", "严重"), ("(血尿|蛋白尿|肌酐|肾损)", "肾脏毒性", "严重"),
    ("(惊厥|抽搐|癫痫|角弓反张)", "中枢神经毒性", "严重"), ("(昏迷|晕厥|休克|虚脱)", "全身严重反应", "严重"),
    ("(白细胞|血小板|骨髓|贫血)", "骨髓抑制", "严重"), ("(致畸|致癌|致突变)", "遗传毒性", "严重"),
    ("(死胎|流产|堕胎|妊娠禁用)", "生殖毒性", "严重"),
]
# item, ld50 (mg/kg), safe dose (g), pregnancy, reactions (type, severity)
TOXIC = [
    ("附子", 1.8, 15.0, "禁用", [("心脏毒性", "严重"), ("神经系统毒性", "中度"), ("胃肠道反应", "轻度")]),
    ("乌头", 1.2, 3.0, "禁用", [("心脏毒性", "严重"), ("神经毒性", "中度"), ("胃肠道反应", "中度")]),
    ("川乌", 1.2, 9.0, "禁用", [("心脏毒性", "严重"), ("神经毒性", "中度")]),
    ("草乌", 0.9, 6.0, "禁用", [("全身毒性", "严重"), ("心脏毒性", "严重")]),
    ("马钱子", 3.27, 0.6, "禁用", [("中枢兴奋", "严重"), ("肝肾毒性", "中度")]),
    ("雷公藤", 0.87, 30.0, "禁用", [("生殖毒性", "严重"), ("骨髓抑制", "中度")]),
    ("细辛", 123.0, 3.0, "慎用", [("肝肾毒性", "中度"), ("过敏反应", "轻度")]),
    ("朱砂", 18.0, 0.5, "禁用", [("重金属中毒", "严重")]),
    ("雄黄", 3.2, 0.2, "禁用", [("砷中毒", "严重"), ("致癌性", "严重")]),
    ("半夏", 325.0, 9.0, "慎用", [("黏膜刺激", "轻度"), ("过敏性紫癜", "中度")]),
]
# first item, second item, risk level, interaction type, evidence level
PAIRS = [
    ("附子", "半夏", "高", "十八反", "A"), ("乌头", "半夏", "高", "十八反", "A"), ("附子", "瓜蒌", "高", "十八反", "A"), ("附子", "贝母", "高", "十八反", "A"),
    ("附子", "白及", "高", "十八反", "B"), ("乌头", "瓜蒌", "高", "十八反", "A"), ("乌头", "贝母", "高", "十八反", "A"), ("甘草", "甘遂", "高", "十八反", "A"),
    ("甘草", "大戟", "高", "十八反", "A"), ("甘草", "芫花", "高", "十八反", "A"), ("甘草", "海藻", "中", "十八反", "C"), ("藜芦", "人参", "高", "十八反", "A"),
    ("藜芦", "细辛", "高", "十八反", "A"), ("人参", "五灵脂", "中", "十九畏", "B"), ("丁香", "郁金", "中", "十九畏", "B"), ("硫黄", "朴硝", "高", "十九畏", "B"),
    ("水银", "砒霜", "极高", "十九畏", "A"), ("狼毒", "密陀僧", "高", "十九畏", "B"), ("巴豆", "牵牛子", "高", "十九畏", "B"), ("川乌", "犀角", "中", "十九畏", "C"),
    ("草乌", "麻黄", "中", "药理拮抗/协同", "D"), ("马钱子", "麝香", "高", "药理协同增毒", "B"),
]
# family, members, toxicity type, base risk
FAMILIES = [
    ("乌头类", ["附子", "乌头", "川乌", "草乌", "雪上一枝蒿"], "心脏毒性+神经毒性", "高"),
    ("含汞类", ["朱砂", "水银", "轻粉", "红粉"], "肝肾毒性+神经毒性", "高"),
    ("含砷类", ["雄黄", "砒石", "砒霜"], "肝肾毒性+遗传毒性", "高"),
    ("攻下逐瘀类", ["大黄", "芒硝", "甘遂", "大戟", "芫花", "巴豆", "牵牛子"], "胃肠道刺激+生殖毒性", "中"),
    ("强心苷类", ["夹竹桃", "万年青", "罗布麻"], "心脏毒性", "高"),
    ("动物毒性类", ["斑蝥", "蟾酥", "红娘子", "青娘子"], "多器官毒性", "高"),
]
# word in a toxicity type, reaction it implies, severity
TYPE_RULES = [
    ("心脏", "心脏毒性", "严重"), ("神经", "神经系统", "中度"), ("肝肾", "肝脏毒性", "严重"), ("肝肾", "肾脏毒性", "严重"),
    ("胃肠道", "胃肠道反应", "轻度"), ("生殖", "生殖毒性", "严重"), ("遗传", "遗传毒性", "严重"),
]
WORDS = RiskWords(
    levels={"极高": 1.0, "高": 0.75, "中": 0.45, "低": 0.2, "极低": 0.05}, evidence={"A": 1.0, "B": 0.8, "C": 0.5, "D": 0.3},
    high="高", medium="中", low="低", extreme="极高", safe="安全", organ_words=("肝脏毒性", "肾脏毒性", "肝肾"), banned=("禁用", "忌用"), caution="慎用",
    inferred="忌用（推理）", unknown="未知", overlap_type="毒性叠加风险", family_type="专家推理", analogy_type="专家推理-类推禁忌", organ_type="专家推理-共同代谢靶点",
)
# ---- end of fixed values ----

CASE_LEXICON = Lexicon(POSITIVE, NEGATIVE, INTENSIFIERS, NEGATIONS, TIME_PATTERNS)


def knowledge_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The default knowledge tables under the argument names of ``operators.risk``."""
    return {
        "toxic": spark.createDataFrame([(i, ld, mx, p) for i, ld, mx, p, _ in TOXIC], "item string, ld50 double, max_dose double, pregnancy string"),
        "reactions": spark.createDataFrame([(i, t, s) for i, _, _, _, rs in TOXIC for t, s in rs], "item string, type string, severity string"),
        "pairs": spark.createDataFrame(PAIRS, "herb_a string, herb_b string, risk_level string, interaction_type string, evidence_level string"),
        "families": spark.createDataFrame([(m, f, t, b) for f, ms, t, b in FAMILIES for m in ms], "item string, family string, toxicity_type string, base_risk string"),
        "type_rules": spark.createDataFrame(TYPE_RULES, "word string, type string, severity string"),
    }
