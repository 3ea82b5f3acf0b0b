"""Messages in Turkish and English, falling back from English to the key."""

from __future__ import annotations

MESSAGES = {
    "tr": {"load": "Yükle", "normalize": "Normalleştir", "impute": "Doldur", "match": "Eşleştir", "missing": "Eksik", "clean": "Temiz", "anomaly": "Anomali", "excellent": "Mükemmel", "good": "İyi", "fair": "Orta", "poor": "Zayıf", "critical": "Kritik"},
    "en": {"load": "Load", "normalize": "Normalize", "impute": "Impute", "match": "Match", "missing": "Missing", "clean": "Clean", "anomaly": "Anomaly", "excellent": "Excellent", "good": "Good", "fair": "Fair", "poor": "Poor", "critical": "Critical"},
}


def text(key: str, lang: str = "en", **values) -> str:
    message = MESSAGES.get(lang, {}).get(key) or MESSAGES["en"].get(key) or key
    return message.format(**values) if values else message


def missing_keys(lang: str, against: str = "tr") -> set[str]:
    return set(MESSAGES[against]) - set(MESSAGES.get(lang, {}))


def score_label(score: float, lang: str = "en") -> str:
    key = "excellent" if score >= 90 else "good" if score >= 75 else "fair" if score >= 60 else "poor" if score >= 40 else "critical"
    return text(key, lang)
