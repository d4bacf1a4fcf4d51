"""Correct text of scripts that the clean sample does not hold, and windows of any length."""

import random

import numpy as np
import pytest

from inkloom.llm import encoding
from tests.llm.test_page_operators import CLEAN, labelled

CORRECT = [
    "Иван Петров пишет о людях и о городе", "Санкт-Петербург — «Москва»", "Україна — її мова", "ПРИВЕТ ВСЕМ",
    "Το γρήγορο καφέ σκυλί τρέχει", "αβγ δεζ ∑∏∫", "Zażółć gęślą jaźń, proszę państwa", "Łódź i Kraków", "Příliš žluťoučký kůň úpěl ďábelské ódy",
    "Rødgrød med fløde på bordet", "Það er gott að búa á Íslandi", "São Paulo, coração e informação", "Güneşli bir gün, şöyle böyle", "Tiếng Việt có dấu thanh",
    "これは日本語の文章です。カタカナもあります", "東京都渋谷区", "ｱｲｳｴｵ ｶﾀｶﾅ", "한국어 문장은 이렇게 생겼습니다", "설정 파일을 불러오는 중 오류", "ㄅㄆㄇㄈ ㄓㄨㄤ ㄧㄣ",
    "هذا نص باللغة العربية للاختبار", "שלום עולם, זה טקסט", "ภาษาไทยเป็นภาษา", "┌──────┐│ abc │└──────┘", "這是一段繁體中文的測試文字，請勿修改", "∀x ∈ ℝ: x² ≥ 0 ⇒ √x²=|x|",
    "２０２４－０２－１７ ０９：３５：００", "Boletín de la redacción · jardín", "北京 Łukasz 与 Ærø 合作",
]


@pytest.fixture(scope="module")
def model():
    return encoding.EncodingModel.train(CLEAN)


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_of_any_script_is_unflagged(model, text):
    assert labelled(model, text) == []
    assert labelled(model, f"El jardín · {text} · la redacción") == []


def test_an_example_does_not_hide_garbled_text(model):
    assert labelled(model, "Mal leída, la ñ pasa a ser «Ã±»; el jardín lo hizo") == []
    assert labelled(model, "Le carnet Â« des Â» lecteurs de l’Ã©tÃ©")


def test_text_garbled_twice_comes_back_whole(model):
    text = "索引文件悄悄修好了消息队列，原因其实在别处，我们决定先放着"
    bad = encoding.garble(text, "utf8>cp1252 twice")
    (kept,) = labelled(model, bad)
    assert kept[3] == text


def test_a_window_of_a_million_characters(model):
    rng = random.Random(4)
    bad = encoding.garble("".join(rng.choices("我们决定先放着因为数据库的连接还没有配置好", k=340_000)), "utf8>cp1252")
    assert len(bad) > 1_000_000
    spans = model.spans([bad, "ok", CLEAN[0]])
    assert sum(b - a for a, b, _ in spans[0]) > 0.99 * len(bad) and not spans[1] and not spans[2]


def test_long_windows_are_labelled_in_stretches(model, monkeypatch):
    bad = encoding.garble("我们决定先放着因为数据库的连接还没有配置好" * 30, "utf8>cp1252")
    codes = model._codes(bad, 0, len(bad), set())
    (whole,) = model._viterbi([codes])
    monkeypatch.setattr(encoding, "CELLS", 64)
    (cut,) = model._label([codes])
    assert np.mean((whole >= 0) == (cut >= 0)) > 0.99
