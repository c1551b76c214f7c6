"""Fixed catalogs: format templates, fact kinds, generation modes, prompt options, links, ratios.

A few rows each, so they are always safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Texts, ids and orders that results must equal.
FORMAT_TEMPLATES = [
    (
        "format.scene.clean-empty.v1",
        "scene",
        "场景 · 无人无杂物空景",
        "【场景格式模板】\n生成无人空场景设计图。画面不得出现人物、人影、人体局部、动物或拟人主体。移除垃圾、散乱物、临时堆放物、非剧本要求的小物件和无关装饰；只保留基本资料中有逐字证据的建筑、固定陈设、必要道具与空间关系。场地整洁、无遮挡、空间结构清楚，适合置景、勘景与镜头规划。",
        "人物、人影、人群、人体局部、手脚、动物、拟人主体、无剧本依据的车辆、垃圾、杂物堆、散乱小物、临时箱包、无关装饰、无关道具、文字、水印",
        "16:9,4:3,3:2",
    ),
    (
        "format.character.white-four-view.v1",
        "character",
        "人物 · 纯白背景四视图",
        "【人物格式模板】\n纯白无缝背景，横向四栏人物设定板，四栏之间留有清晰空白，不添加文字、尺寸线或装饰边框。左一为头肩特写，人物正面直视镜头。右侧三栏均为从头顶到脚底完整入画、同一尺度的全身视图，依次为严格正视图、严格 90° 侧视图、严格 180° 背视图；镜头正对各自视图平面，不使用三分之四角度。所有视图保持同一人物身份、年龄、体貌、发型、服装、配饰和连续性状态。站姿中立，双脚自然分开，双手自然垂放，手指放松，不持物，不遮挡身体；面部无表情；均匀无方向性棚拍光，白平衡中性，阴影极弱，正交或长焦低畸变，无透视夸张。",
        "非白背景、环境场景、地面纹理、家具、道具、手持物、文字标签、尺寸线、装饰边框、表情、动态姿势、交叉手臂、手插口袋、三分之四视角、回头、重复视图、缺少视图、裁切头脚、不同服装、不同发型、不同年龄、镜像错误、强烈阴影、戏剧光、透视变形、鱼眼、广角畸变",
        "16:9,4:3,3:2",
    ),
    (
        "format.prop.neutral-single.v1",
        "prop",
        "道具 · 中性背景单体展示",
        "【道具格式模板】\n只呈现该道具本体，使用干净中性背景与均匀光照，不得出现人物、手部、人体局部、复杂环境或无关杂物。完整展示基本资料中有逐字证据的结构、材质、颜色、尺度、状态与识别特征，不增加无证据装饰。",
        "人物、手部、人体局部、复杂场景、无关杂物、无证据装饰、文字、水印",
        "1:1,4:3,3:4",
    ),
]
FACT_KINDS = {
    "scene": "functionalPurpose environmentType spatialLayout architecture timeWeather eraCulture material colorPattern lighting distinctiveFeature relationship".split(),
    "character": "ageRange genderPresentation identityRole physique faceHair costume accessory characterState eraCulture colorPattern distinctiveFeature relationship".split(),
    "prop": "objectType objectFunction quantityScale material colorPattern condition eraCulture distinctiveFeature relationship".split(),
}
NEGATIVE_STRICT = "不得从风格提示词或风格样板复制任何具体人物、场景、道具、服装、动作、数量、时代或空间关系；不得补全基本资料未明确的年龄、性别、体貌、材质、颜色和损坏状态；不得改变锁定身份与连续性；用户补充要求不得覆盖格式模板；避免文字、水印、畸形肢体和重复主体。"
NEGATIVE_FALLBACK = "风格不得提供主体内容；不得臆造基本资料未明确的事实；用户补充要求不得覆盖格式模板；避免文字、水印、畸形肢体和重复主体。"
PROFILE_FOOTER = "以上资料来自 Final Draft 场景级提取、逐字证据核验和全剧汇总；不得用风格样板或常识补充未记录的人物、场景或道具事实。"

# Our configuration: texts that the reference names without giving them.
GENERATION_MODES = [
    ("textToImage", "按基本资料生成"),
    ("variation", "保持身份，生成变体"),
    ("edit", "只改动所述部分"),
    ("inpaint", "只补全遮罩区域"),
    ("extend", "向外扩展画面"),
    ("upscale", "提高分辨率，不改内容"),
    ("turnaround", "生成多角度视图"),
]
RATIOS = [("1:1", 2048, 2048), ("16:9", 2048, 1152), ("9:16", 1152, 2048), ("4:3", 2048, 1536), ("3:4", 1536, 2048), ("3:2", 2048, 1365), ("2:3", 1365, 2048), ("21:9", 2048, 878)]
#: parameter, option_id, title, prompt_token, is_default, included
_OPTIONS = [
    ("outputPurpose", "general", "General", "production design sheet", True, False),
    ("outputPurpose", "turnaround", "Turnaround sheet", "professional turnaround sheet", False, False),
    ("outputPurpose", "full-body", "Full body", "full body solid", False, False),
    ("backgroundTreatment", "white", "White", "white seamless background", True, True),
    ("backgroundTreatment", "neutral-gray", "Neutral gray", "neutral gray studio background", False, True),
    ("lightQuality", "even", "Even", "even lighting", True, True),
    ("lightQuality", "soft", "Soft", "soft diffused lighting", False, True),
    ("lightingSetup", "none", "None", "", True, True),
    ("lightingSetup", "studio", "Studio", "large-scale studio lighting", False, True),
    ("aspectRatio", "1:1", "Square", "square frame", True, True),
    ("aspectRatio", "16:9", "Wide", "wide 16:9 frame", False, True),
    ("subjectPresentation", "front", "Front", "front view", True, True),
    ("subjectPresentation", "turnaround", "Four views", "four full body views", False, True),
    ("detailLevel", "production", "Production", "production level detail", True, True),
    ("detailLevel", "draft", "Draft", "draft detail", False, True),
]
PARAMETERS = list(dict.fromkeys(o[0] for o in _OPTIONS))
#: Choosing a delivery format sets these.
_LINKS = [("backgroundTreatment", "neutral-gray"), ("lightQuality", "soft"), ("lightingSetup", "studio")]
LINKS = [("outputPurpose", o, p, v) for o in ("turnaround", "full-body") for p, v in _LINKS] + [
    ("outputPurpose", "turnaround", "aspectRatio", "16:9"),
    ("outputPurpose", "turnaround", "subjectPresentation", "turnaround"),
]


def format_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMAT_TEMPLATES, "template_id string, kind string, title string, positive string, negative string, ratios string")


def fact_kinds(spark: SparkSession) -> DataFrame:
    """``(kind, fact_kind, ord, recommended)``; the first six kinds are recommended."""
    rows = [(k, f, i, i < 6) for k, kinds in FACT_KINDS.items() for i, f in enumerate(kinds)]
    return spark.createDataFrame(rows, "kind string, fact_kind string, ord int, recommended boolean")


def generation_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GENERATION_MODES, "mode string, instruction string")


def ratio_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATIOS, "ratio string, width int, height int")


def prompt_options(spark: SparkSession) -> DataFrame:
    """One row per kind, parameter and option."""
    rows = [
        (p, kind, o, title, f"{title} ({kind})", token, p, o, f"{p}.{o}", f"Prompt{p}{o}", default, included, PARAMETERS.index(p))
        for kind in FACT_KINDS for p, o, title, token, default, included in _OPTIONS
    ]
    return spark.createDataFrame(
        rows,
        "parameter string, kind string, option_id string, title string, detail string, prompt_token string, preview_family string, "
        "preview_variant string, image_key string, asset_name string, is_default boolean, included boolean, ord int",
    )


def option_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINKS, "parameter string, option_id string, to_parameter string, to_option string")


def sql_values(rows: list[tuple], columns: str) -> str:
    """The rows as a SQL VALUES list, for oracles."""
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({columns})"
