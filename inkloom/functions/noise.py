"""Line filter for promotional and navigational lines, as one Column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import let, trim_ws


@dataclass(frozen=True)
class NoiseRules:
    """Patterns (common to Java and RE2) of lines to drop, of lines that end a text, and words that mark short lines."""

    drop: tuple[str, ...]
    stop: tuple[str, ...]
    words: tuple[str, ...]
    short: int = 30

    @property
    def drop_pattern(self) -> str:
        return "|".join(f"(?:{p})" for p in self.drop)

    @property
    def stop_pattern(self) -> str:
        return "|".join(f"(?:{p})" for p in self.stop)

    @property
    def word_pattern(self) -> str:
        return "|".join(self.words)


RULES = NoiseRules(
    drop=(
        "(?i)follow us (?:for|on)", "(?i)sign up for our", "(?i)share this (?:piece|post|article)", "(?i)all rights reserved", "(?i)abonnieren sie", "(?i)partager cet article", "(?i)comparte esta entrada",
        "点一?下?.{0,8}(?:分享|关注)", "长按.{0,8}(?:识别|订阅)", "扫.{0,6}码.{0,8}(?:关注|领取)", "未经.{0,8}(?:许可|授权).{0,12}(?:转载|复制)", "(?:原创|首发).{0,10}转载请注明", "点个赞|三连", "版权归.{0,12}所有", "举报这篇",
        # calls to follow, share, join and pay
        "点击.{0,12}关注", "欢迎.{0,6}关注", "(?:有用|不错|帮助).{0,16}(?:点赞|在看|转发)", "点赞.{0,10}(?:收藏|关注)", "(?:首发|原创)(?:于|自).{0,20}(?:公众号|专栏|博客|社区)", "扫码.{0,12}(?:回复|获取|领取)", "回复.{0,12}即可(?:获取|领取)", "商务(?:合作|联系)", "加.{0,4}微信.{0,8}(?:进群|入群)|入.{0,6}交流群",
        # rights
        "^版权声明[:：]", "禁止.{0,4}转载", "著作权.{0,12}所有",
        # counters and tools of blog pages
        "^分享(?:到)?[:：]?$", "^(?:喜欢|推荐|阅读|收藏|评论)[ (（:：]{0,2}[0-9]+[)）]?$", "^阅读[|┊｜]", "[|┊｜] ?打印", "^打印(?:本文|本页)?$", "举报/|^举报$", "^加载中", "^字体(?:大小)?[:：]", r"^顶 ?\([0-9]+\)", r"\(javascript:", r"#(?:write|comment)\)$", "^赠?金笔$", "^[•·] ?(?:博客|荣誉|获赠|赠出).{0,8}[:：]",
    ),
    stop=("^(?:上|下|前|后)一篇[:：]", "(?i)^copyright ©", "^相关推荐$", "(?i)^related posts$", "意见反馈.{0,4}留言", "^.{0,12}版权所有$"),
    words=("关注", "在看", "二维码", "交流群", "订阅", "读者群"),
)


def filter_noise(text: Column, rules: NoiseRules = RULES) -> Column:
    """``text`` without noise lines: blank lines stay, a stop line ends it, 3 and more line ends become 2.

    NULL gives ''.
    """

    def filtered(lines: Column) -> Column:
        stop = F.array_min(F.transform(lines, lambda line, i: F.when(line["bare"].rlike(rules.stop_pattern), i)))
        kept = let(stop, lambda at: F.slice(lines, 1, F.coalesce(at, F.size(lines))))
        return F.array_join(F.transform(F.filter(kept, stays), lambda line: line["raw"]), "\n")

    def stays(line: Column) -> Column:
        bare = line["bare"]
        short = (F.length(bare) < rules.short) & bare.rlike(rules.word_pattern)
        return (bare == "") | ~(short | bare.rlike(rules.drop_pattern))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.struct(line.alias("raw"), trim_ws(line).alias("bare")))
    return trim_ws(F.regexp_replace(let(lines, filtered), r"\n{3,}", "\n\n"))
