"""Thresholds and word lists of the curation jobs."""

from __future__ import annotations

import dataclasses
import json
import warnings
from dataclasses import dataclass, field

# --- fixed values: word lists, in the order hits are reported -----------------------------
WHITELIST = (
    "舞蹈", "独舞", "solo", "个人", "纯享", "全身", "练习室", "cover", "one take", "一镜到底",
    "现代舞", "街舞", "中国舞", "民族舞", "古典舞", "比赛", "选秀",
)
BLACKLIST = (
    "多人", "齐舞", "团舞", "reaction", "解说", "盘点", "采访", "花絮", "预告", "鬼畜", "MAD",
    "口播", "vlog", "综艺", "教程", "教学", "拆解", "分析",
)
AUDIO_BOOST = ("原声", "高音质", "无解说", "纯享", "练习室", "无字幕", "live", "one take", "无剪辑")
AUDIO_PENALTY = (
    "口播", "采访", "讲解", "vlog", "收音差", "杂音", "现场太吵", "嘈杂", "麦克风故障", "音效差",
)
GENERAL_QUERIES = (
    "舞蹈", "编舞", "独舞", "solo", "个人", "个人cut", "纯享", "全身", "练习室", "cover",
    "one take", "一镜到底",
)
GENRE_WORDS: dict[str, tuple[str, ...]] = {
    "urban": ("urban", "urban dance", "urban编舞", "urban舞蹈", "都市编舞"),
    "hoping": ("hoping", "popping", "poppin", "机械舞", "震感舞", "电流舞"),
    "hiphop": ("hiphop", "hip-hop", "hip hop", "嘻哈舞", "街舞hiphop", "hiphop编舞"),
    "breaking": ("breaking", "breakdance", "b-boy", "b-girl", "霹雳舞", "地板动作"),
    "locking": ("locking", "lockin", "lock", "锁舞", "街舞locking"),
    "jazz": ("jazz", "jazz dance", "爵士舞", "jazz编舞", "街舞爵士"),
    "classical": (
        "ballet", "ballet dance", "classical ballet", "variation ballet", "芭蕾", "芭蕾舞", "古典芭蕾",
        "芭蕾独舞", "芭蕾 solo", "芭蕾编舞", "芭蕾舞者", "足尖", "足尖舞", "足尖练习", "pointe", "剧院芭蕾",
        "舞剧芭蕾", "芭蕾片段", "芭蕾课堂", "芭蕾排练", "芭蕾变奏", "芭蕾舞剧", "天鹅湖", "胡桃夹子",
        "睡美人", "吉赛尔",
    ),
    "country": (
        "country dance", "乡村舞", "牛仔舞", "乡村风格舞蹈", "country swing", "country舞", "乡村摇摆舞",
        "line dance", "country line dance", "排舞", "乡村排舞", "线舞", "cowboy dance",
    ),
    "metal": ("metal dance", "金属乐舞蹈", "metal风格编舞", "heavy metal舞蹈", "metal舞", "摇滚金属舞蹈"),
    "reggae": ("reggae", "reggae dance", "雷鬼", "雷鬼舞", "雷鬼舞蹈", "reggae舞蹈", "雷鬼风格"),
    "rock": ("rock dance", "摇滚舞", "rock舞蹈", "rockandroll舞蹈", "rock编舞", "摇滚风格编舞", "rock and roll舞"),
    "disco": ("disco", "disco dance", "迪斯科", "迪斯科舞", "迪斯科舞蹈", "disco编舞", "复古迪斯科", "迪斯科风格"),
    "blues": ("blues dance", "布鲁斯舞", "蓝调舞蹈", "blues舞", "布鲁斯", "蓝调舞", "blues编舞"),
    "uighur": ("维吾尔族舞", "维族舞", "新疆舞", "维吾尔舞蹈", "维吾尔舞", "新疆民族舞", "维吾尔族舞蹈"),
    "tai": (
        "傣族舞", "傣舞", "孔雀舞", "民族舞 傣族", "泰国舞", "泰式舞蹈", "傣族舞蹈", "傣族孔雀舞", "泰国舞蹈", "泰国传统舞",
    ),
    "korea": ("韩舞", "Kpop舞蹈", "K-POP cover", "韩舞 cover", "韩国舞蹈", "朝鲜族舞", "民族舞 朝鲜族", "朝鲜族舞蹈"),
    "hmong": ("苗族舞", "苗族舞蹈", "苗舞", "民族舞 苗族", "苗族芦笙舞", "芦笙舞"),
    "hantang": ("汉唐舞", "汉唐古典舞", "汉唐风舞蹈", "汉唐舞蹈", "汉唐古典", "汉唐风", "汉唐"),
    "shenyun": ("身韵", "古典舞身韵", "中国古典舞身韵", "身韵组合", "身韵练习", "身韵训练", "身韵组合训练"),
    "dunhuang": ("敦煌舞", "敦煌飞天舞", "敦煌古典舞", "敦煌舞蹈", "飞天舞", "敦煌飞天", "敦煌壁画舞", "壁画舞"),
}
# --- end of fixed values ------------------------------------------------------------------


@dataclass(frozen=True)
class CurationConfig:
    """Keyword lists and thresholds; every list is a parameter."""

    # --- fixed values: the published defaults -------------------------------------------------
    min_duration_sec: float = 30.0
    max_duration_sec: float = 300.0
    min_view_count: int = 0
    whitelist: tuple[str, ...] = WHITELIST
    blacklist: tuple[str, ...] = BLACKLIST
    audio_boost: tuple[str, ...] = AUDIO_BOOST
    audio_penalty: tuple[str, ...] = AUDIO_PENALTY
    genres: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(GENRE_WORDS))
    weight_whitelist: float = 0.40
    weight_genre: float = 0.35
    weight_audio_words: float = 0.25
    solo_threshold: float = 0.75
    uncertain_threshold: float = 0.45
    min_valid_person_ratio: float = 0.9
    max_crowded_ratio: float = 0.1
    min_audio_present_ratio: float = 0.75
    min_loudness_mean: float = -32.0
    max_clipping_ratio: float = 0.01
    min_snr_proxy: float = 10.0
    speech_ratio_max: float = 0.35
    min_music_conf: float | None = None
    audio_threshold: float = 0.60
    weight_solo: float = 0.55
    weight_audio: float = 0.30
    weight_metadata: float = 0.15
    unstable_vision_audio_rescue: bool = True
    keep_threshold: float = 0.65
    drop_threshold: float = 0.30
    download_keep: bool = True
    download_review: bool = False
    download_min_fusion_score: float = 0.0
    # --- end of fixed values ----------------------------------------------------------------

    @classmethod
    def from_json(cls, text: str) -> CurationConfig:
        """Overrides from a JSON object; unknown keys are reported and ignored."""
        given = json.loads(text)
        known = {f.name for f in dataclasses.fields(cls)}
        for key in sorted(set(given) - known):
            warnings.warn(f"unknown setting {key!r} ignored", stacklevel=2)
        clean = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
        if isinstance(clean.get("genres"), dict):
            clean["genres"] = {g: tuple(w) for g, w in clean["genres"].items()}
        return cls(**clean)


DEFAULT = CurationConfig()
