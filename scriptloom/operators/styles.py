"""Style cards: packs, trees, neutral fragments, near-duplicate signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, stable_id, trim_unicode
from ..scratch import durable
from .trees import climb

#: What a style clause may speak of: medium, rendering, palette, light, composition, lens, line, texture, mood. Our configuration.
STYLE_TERMS = {
    "medium": "watercolor, watercolour, oil painting, gouache, ink wash, ink drawing, pencil drawing, pencil sketch, charcoal drawing, pastel drawing, acrylic painting, screen print, engraving, etching, woodcut, "
    "collage, photograph, photography, photographic, photo, film, film still, digital painting, digital art, 3d, comic, cartoon, anime, manga, illustration, painting, drawing, 水彩, 油画, 水墨, 水墨画, 素描, 版画, 胶片, 摄影, 插画, 漫画, 动画, 水粉, 工笔, 手绘",
    "rendering": "render, rendering, rendered, realistic, realism, photorealistic, hyperrealistic, stylized, stylised, painterly, impressionism, impressionist, expressionism, expressionist, cubism, minimalism, "
    "minimalist, abstract, flat shading, cel shading, cel shaded, shading, 渲染, 写实, 写意, 印象派, 表现主义, 极简, 抽象, 平涂",
    "palette": "palette, color, colour, color scheme, color grading, hue, tone, toned, monochrome, saturated, desaturated, saturation, contrast, sepia, black and white, 色彩, 色调, 配色, 冷色, 暖色, 冷色调, 暖色调, 饱和, 饱和度, 对比度, 单色, 黑白",
    "light": "light, lit, lighting, backlit, backlight, rim light, rim lighting, glow, shadow, chiaroscuro, diffuse, diffused, ambient, volumetric, exposure, low key, high key, 光, 光线, 光影, 柔光, 逆光, 侧光, 侧逆光, 顶光, 阴影, 明暗, 曝光",
    "composition": "composition, symmetrical, symmetry, asymmetrical, framing, negative space, rule of thirds, 构图, 对称, 留白",
    "lens": "lens, bokeh, wide angle, wide shot, telephoto, macro, fisheye, focal length, depth of field, shallow focus, aperture, anamorphic, close-up, close up, panorama, 镜头, 景深, 焦距, 广角, 特写, 俯拍, 仰拍, 长焦, 微距",
    "line": "line, linework, line art, lineart, outline, contour, stroke, brush stroke, brushwork, hatching, 线条, 轮廓, 笔触, 勾线",
    "texture": "texture, textured, grain, grainy, film grain, matte, glossy, noise, paper texture, canvas texture, 质感, 颗粒, 纹理, 哑光",
    "mood": "mood, moody, atmosphere, atmospheric, dreamy, romantic, melancholic, serene, gloomy, dramatic, cinematic, nostalgic, whimsical, 氛围, 情绪, 意境, 梦幻",
    "manner": "style, aesthetic, look, 风格, 画风",
}
#: Words that may stand beside a style term and say nothing of a subject. Our configuration.
NEUTRAL_TERMS = (
    "a, an, the, of, in, with, and, or, by, very, soft, hard, warm, cool, cold, bright, dark, deep, low, high, bold, subtle, gentle, delicate, fine, clean, clear, rich, muted, vivid, smooth, rough, strong, stable, "
    "balanced, natural, even, dense, sparse, thick, thin, loose, limited, overall, german, french, japanese, chinese, classical, modern, vintage, retro, traditional, "
    "的, 与, 和, 及, 低, 高, 冷, 暖, 强, 弱, 柔和, 强烈, 细腻, 粗糙, 明亮, 统一, 整体, 自然, 稳定, 均衡, 传统, 现代, 复古, 中式, 日式"
)


def _listed(terms: str) -> list[str]:
    return [t.strip() for t in terms.split(",")]


def trie_pattern(terms) -> str:
    """A pattern for any of the terms, from a trie of their characters; of two that fit the longer is taken.

    Terms of Latin letters are whole words and may have a plural s; a blank in them stands for white space.
    """
    trie: dict = {}
    for term in terms:
        node = trie
        for letter in [*term, "s?(?![a-z0-9])" if term.isascii() else ""]:
            node = node.setdefault(letter, {})
        node[None] = {}

    def text(node: dict) -> str:
        inner = [(r"\s+" if k == " " else "\\-" if k == "-" else k) + text(v) for k, v in sorted(((k, v) for k, v in node.items() if k is not None), key=lambda x: (len(x[0]) != 1, x[0]))]
        if None in node and inner:
            return f"(?:{'|'.join([*inner, ''])})"
        return "" if not inner else inner[0] if len(inner) == 1 else f"(?:{'|'.join(inner)})"

    return text(trie)


#: One style term, one style or neutral term (as a whole), and a clause that such terms cover from end to end.
_STYLE = trie_pattern(t for group in STYLE_TERMS.values() for t in _listed(group))
_EITHER = trie_pattern([*(t for group in STYLE_TERMS.values() for t in _listed(group)), *_listed(NEUTRAL_TERMS)])
COVERED = rf"^(?:[\s\-/]*+(?<![a-z0-9])(?>{_EITHER}))++[\s\-/]*$"
STYLE_TERM = rf"(?<![a-z0-9])(?:{_STYLE})"


def card_id() -> Column:
    """The id of an imported card: repository, commit, path and original id."""
    return stable_id(F.col("repository"), F.col("source_commit"), F.col("source_path"), F.col("original_id"))


def style_pack_topk(cards: DataFrame, k: int = 7) -> DataFrame:
    """The first k unique non-empty prompts of each source file: ``(source_path, nth, card_id, prompt)``."""
    clean = cards.withColumn("key", canonical_key(F.col("prompt"))).where("key <> ''").withColumn("card_id", card_id())
    first = clean.groupBy("source_path", "key").agg(F.min(F.struct("ord", "card_id", "prompt")).alias("first")).select("source_path", "first.*")
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("source_path").orderBy("ord"))).where(F.col("nth") <= k)
    return ranked.select("source_path", "nth", "card_id", "prompt")


def style_only(c: Column) -> Column:
    """The clauses of a prompt that speak of a style and of nothing else, in order; all others go.

    Terms cover a clause from end to end, each time the longest that fits; a clause with any word that is
    neither a style term nor neutral beside one may name a subject, so it goes.
    """
    speaks = lambda x: F.lower(x).rlike(COVERED) & F.lower(x).rlike(STYLE_TERM)
    return F.array_join(F.filter(F.transform(F.split(c, "[，,；;。]"), trim_unicode), speaks), "，")


def selectable_styles(cards: DataFrame) -> DataFrame:
    """Library cards with ``section`` default, experiments apart; archived ones are hidden."""
    return cards.where(F.col("lifecycle") != "archived").withColumn("section", F.when(F.col("lifecycle") == "library", "default").otherwise("experiment"))


def style_paths(cards: DataFrame) -> DataFrame:
    """``(card_id, path, depth)``: titles from the root to the card, by pointer doubling.

    Below a parent that isn't there a path begins at the card under it. On or below a cycle there is
    no root: path and depth are null.
    """
    title = F.coalesce("title", F.lit(""))
    up = climb(cards, {"path": title}, lambda low, high: {"path": F.concat(high("path"), F.lit(" / "), low("path"))})
    rooted = F.col("up").isNull()
    return up.select("card_id", F.when(rooted, F.col("path")).alias("path"), F.when(rooted, F.col("steps")).cast("int").alias("depth"))


def subtree(cards: DataFrame, roots: DataFrame) -> DataFrame:
    """Cards at or below the given ones that may be archived, restored or deleted: ``(card_id)``.

    Built-in cards (``built_in``, where the table has it) are protected: as roots they don't count,
    below a root they are left out. Of a cycle with a root all cards are below it.
    """
    if "built_in" in cards.columns:
        roots = roots.join(cards.where("built_in").select("card_id"), "card_id", "left_anti")
    marked = cards.join(roots.select("card_id").distinct().withColumn("hit_", F.lit(True)), "card_id", "left")
    up = climb(marked, {"hit": F.coalesce("hit_", F.lit(False))}, lambda low, high: {"hit": low("hit") | high("hit")})
    below = up.where("hit").select("card_id")
    return below.join(cards.where("built_in").select("card_id"), "card_id", "left_anti") if "built_in" in cards.columns else below


def library_faults(cards: DataFrame) -> DataFrame:
    """Library cards without a sample of their own or an inherited one: ``(card_id)``."""
    bare = inherited_sample(cards).where("sample_url is null")
    return cards.where(F.col("lifecycle") == "library").join(bare.select("card_id"), "card_id", "left_semi").select("card_id")


def inherited_sample(cards: DataFrame) -> DataFrame:
    """``(card_id, sample_url, from_depth)``: the sample of the nearest ancestor that has one, else null."""
    own = F.when(F.col("sample_url").isNotNull(), F.struct("sample_url", F.lit(0).cast("bigint").alias("at")))

    def nearest(low, high):
        above = F.when(high("sample").isNotNull(), F.struct(high("sample")["sample_url"].alias("sample_url"), (low("steps") + high("sample")["at"]).alias("at")))
        return {"sample": F.coalesce(low("sample"), above)}

    return climb(cards, {"sample": own}, nearest).select("card_id", "sample.sample_url", F.col("sample.at").cast("int").alias("from_depth"))


#: Rows of one block of signatures at most, and blocks at least if they have 1,024 rows; rows and columns of a product; tasks at most.
BLOCK, LEAST_BLOCKS, STRIPE, MOST_TASKS = 1 << 14, 8, (512, 1024), 4096


def _distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """L2 distances of paired rows, summed component by component."""
    square = np.zeros(len(v))
    for i in range(v.shape[1]):
        square += (v[:, i] - w[:, i]) ** 2
    return np.sqrt(square)


def _nearest_before(ids: np.ndarray, v: np.ndarray, others: np.ndarray, w: np.ndarray, max_dist: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest of the others with a smaller id within ``max_dist``: (place, reuse_id, distance) of those that have one.

    Both are in the order of ids. A product of a stripe of each, small enough for a cache, shows which can be the nearest, up to
    rounding; only their distances are computed.
    """
    parts: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0))]
    size_v, size_w = (v * v).sum(axis=1), (w * w).sum(axis=1)
    # of two rows v.w - w.w / 2, the larger the nearer
    left, right = np.column_stack([v, np.ones(len(v))]), np.column_stack([w, size_w / -2]).T
    slack = 1e-12 * (size_v + size_w.max() + max_dist * max_dist)
    least = (size_v - max_dist * max_dist) / 2 - slack
    for at in range(0, len(v), STRIPE[0]):
        own = slice(at, at + STRIPE[0])
        stop = int(np.searchsorted(others, ids[own][-1]))
        for start in range(0, stop, STRIPE[1]):
            span = slice(start, min(start + STRIPE[1], stop))
            near = left[own] @ right[:, span]
            hit = np.flatnonzero(near.max(axis=1) >= least[own])
            if len(hit):
                near = np.where(others[None, span] < ids[own][hit, None], near[hit], -np.inf)
                rows, columns = np.nonzero(near >= np.maximum(least[own][hit], near.max(axis=1) - 2 * slack[own][hit])[:, None])
                rows, columns = hit[rows] + at, columns + start
                exact = _distances(v[rows], w[columns])
                parts.append((rows[exact <= max_dist], others[columns[exact <= max_dist]], exact[exact <= max_dist]))
    place, reuse, distance = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((reuse, distance, place))
    first = order[np.diff(place[order], prepend=-1) != 0]
    return place[first], reuse[first], distance[first]


def near_duplicate_signatures(signatures: DataFrame, max_dist: float, block: int = BLOCK) -> DataFrame:
    """``(vec_id, reuse_id, distance)``: the nearest row with a smaller id within ``max_dist`` (L2), exact.

    Equal vectors are one: each takes the first of them, at distance 0. Those left are dealt into blocks, and each pair of
    blocks is one group, in which a product of matrices, some rows at a time, shows the rows that can be the nearest. So all
    pairs are met, whatever the distance: the work grows with the square of the rows and is shared by all tasks; a group's
    memory is two blocks and a stripe of their product, and a row is sent once for each block. Vectors with a null or
    non-finite component are near to none, nor are those of different lengths.
    """
    rows = signatures.select("vec_id", F.col("embedding").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    alike = durable(rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "signatures")
    kind = signatures.schema["vec_id"].dataType.simpleString()
    copies = rows.join(alike.withColumnRenamed("vec_id", "reuse_id"), "v").where("reuse_id < vec_id").select("vec_id", "reuse_id", F.lit(0.0).alias("distance"))
    # dealt by hash: blocks of about so many rows
    count = alike.count()
    n = max(1, math.ceil(count / block), min(LEAST_BLOCKS, count // 1024))
    dealt = alike.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("size", F.size("v"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = meets.select("size", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "vec_id", "v")

    def group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, of = table["vec_id"].to_numpy(), table["b"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        one, two = of == key[1].as_py(), of == key[2].as_py()
        sides = [(one, two)] if key[1] == key[2] else [(one, two), (two, one)]
        found = [(ids[a], *_nearest_before(ids[a], v[a], ids[b], v[b], max_dist)) for a, b in sides if a.any() and b.any()]
        parts = [(own[place], reuse, distance) for own, place, reuse, distance in found]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(["vec_id", "reuse_id", "distance"], columns, strict=True)))

    tasks = n * (n + 1) // 2
    nearest = pairs.repartition(min(tasks, MOST_TASKS), "size", "i", "j").groupBy("size", "i", "j").applyInArrow(group, f"vec_id {kind}, reuse_id {kind}, distance double")
    best = F.min_by(F.struct("reuse_id", "distance"), F.struct("distance", "reuse_id"))
    every = nearest.unionByName(copies)
    return every.groupBy("vec_id").agg(best.alias("b")).select("vec_id", "b.reuse_id", F.round("b.distance", 6).alias("distance"))
