"""Problem 7: text garbled by a wrong decoding.

A multinomial classifier over hashed byte bigrams, trained here on synthetically garbled sentences,
predicts the exact chain of encodings of a line; the chain is inverted and kept only if every byte is
strictly decodable. Lines that hold replacement characters are garbled and cannot be restored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.arrow import map_columns
from corpuscle.session import spread

#: Training sentences, by language; own wording. Each is garbled by every chain that its letters allow.
SENTENCES = {
    "de": ["Die Übersicht enthält ungültige Einträge für größere Bücher", "Bitte prüfen, ob die Maße schließlich übereinstimmen", "Straße, Tür, Höhe und Fläche müssen später geändert werden", "Ärger mit Öl: äußerst häufig können Schläuche brüchig werden", "Überprüfung der Länge gemäß Schlüssel löst Rückgabe aus", "nächste Menge gekürzt, weil Gerät zu groß", "Übergröße Ähre Öse Äpfel Übung Straßenschlüssel"],
    "fr": ["Le problème a été réglé après plusieurs années d'études", "Où êtes-vous allés à Noël ? Déjà là-bas, près de la forêt", "La façade dépend du côté où l'élève relève le numéro", "même chaîne répétée, clé vérifiée à l'étape précédente", "français naïf, garçon, leçon, reçu, ça dépasse très bientôt", "Âge, Été, À côté, Île, Œuvre, cœur, sœur, bœuf"],
    "es": ["El tamaño del año pasado según la última medición", "¿Dónde está el niño? ¡Aquí, señor! Mañana comenzará la operación", "añadir línea máxima a la página número único según opción", "corazón, canción, información, envío, límite, fácil, árbol, día", "¿Qué pasó después? ¿Falta algún acento más?"],
    "pt": ["A opção não está disponível até a próxima execução do padrão", "Atenção: três botões são necessários após a medição", "revisão concluída, condição inválida, coração, maçã, órgão, você", "só há ligações à direção, ações e funções úteis", "remoção de exceções não é possível; versões estão lá"],
    "sv": ["Får inte ändras före körningen är slut på kön", "försöker på nytt när längden överstiger gränsen", "räkna om nästa gång, hjälp åt små barn på ön", "Åtgärda även ändringar från förra året så länge"],
    "pl": ["Następny krok może być pusty, jeżeli brak źródła", "zażółć gęślą jaźń i sprawdź później wartość końcową", "błąd: nie można znaleźć ścieżki, proszę spróbować jeszcze raz", "też są różne części, więc łączę je w całość", "Świeże źdźbło trawy rośnie także wśród śniegu", "dzień, noc, księżyc, człowiek, miłość, życie, żółty"],
    "cs": ["Příliš žluťoučký kůň úpěl ďábelské ódy", "následující řádek může být prázdný, chyba čtení souboru", "vždy ověř délku řetězce před uložením změn", "každý měsíc přijde něco nového, říká můj přítel"],
    "tr": ["Bir sonraki çalıştırmaya kadar değer korunur, boş satır sayılmaz", "güncelleme işlemi başarısız oldu, lütfen yeniden deneyin", "öğrenci şiir yazıyor, ağaç büyüyor, ışık söndü"],
    "ru": ["проверка размера и значение до следующего запуска программы", "ошибка при чтении файла, строка не найдена в списке", "старое имя остаётся пустым, если очередь больше ста элементов", "не более трёх попыток на каждый участок сети, затем выход", "Сегодня хорошая погода, мы пойдём гулять в парк после работы", "Количество записей, которые были изменены пользователем за день", "удалить временный объект и повторить запрос ещё раз", "этот метод возвращает новый список чисел и слов", "ПРОВЕРКА ДАННЫХ ЗАВЕРШЕНА, ОШИБОК НЕТ", "Подождите, пока идёт обработка вашего заказа"],
    "uk": ["перевірка розміру черги перед наступним запуском", "помилка читання файлу, рядок не знайдено", "старе значення залишається порожнім до кінця дня"],
    "el": ["η τιμή μένει κενή ως την επόμενη εκτέλεση του προγράμματος", "έλεγχος ορίων πριν από το βήμα και μετά το τέλος", "το σφάλμα εμφανίζεται όταν η λίστα είναι άδεια", "Καλημέρα κόσμε, σήμερα θα πάμε στη θάλασσα", "δεν βρέθηκε αρχείο με αυτό το όνομα στον φάκελο", "ο αριθμός των γραμμών είναι μεγαλύτερος από το όριο", "πρέπει να γίνει έλεγχος ξανά, όπως και την προηγούμενη φορά"],
    "zh": ["下一次运行之前保留旧的数值", "检查仓库里的数量然后排序", "忽略空行并且重新计算长度", "如果文件不存在则返回错误信息", "用户可以修改密码和邮箱地址", "这个函数用来处理所有的请求数据", "今天天气很好我们一起去公园散步"],
    "ja": ["次の工程まで値を保持するようにしてください", "空の行は無視する、在庫の数を確認してから並べ替える", "ファイルが見つからない場合はエラーを返す", "この関数は文字列の長さを計算します", "今日はとても天気がいいので散歩に行きましょう", "処理が終わったら結果を保存し、次のデータを読み込む", "データベースへの接続に失敗しました"],
    "ko": ["다음 실행까지 이전 값을 유지합니다", "빈 줄은 무시하고 길이를 다시 계산하세요", "파일을 찾을 수 없으면 오류를 반환합니다"],
    "typography": ["don’t drop it — see the note…", "the caller’s “first” value wins over ‘ours’", "cost in € per item, not £ or ¥", "range is 2–5 inclusive, ±5 µm at 20 °C", "© 2020 Acme™, all rights reserved®", "½ of • bullets × 3 ÷ 2 § 4 ¶", "it’s → done ✓ “quoted” … – —", "no. 5 · 30° · naïve café résumé"],
}

#: Chains (encoding of the bytes, encoding by which they were read), twice where the damage was done twice.
_UTF8_AS = "cp1252 latin-1 cp1251 cp1250 mac_roman cp437 cp850 koi8-r cp1253 cp1254 iso8859-2 cp866 cp1257 iso8859-15 mac_cyrillic".split()
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *((("utf-8", w),) for w in _UTF8_AS),
    *((("utf-8", w), ("utf-8", w)) for w in ("cp1252", "latin-1")),
    *((("utf-8", "cp1252"),) * 3,),
    *(((r, w),) for r in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic") for w in ("latin-1", "cp1252")),
    *(((r, w),) for r, w in (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"), ("cp1251", "mac_roman"), ("koi8-r", "mac_roman"))),
    *(((r, w),) for r in ("cp1250", "iso8859-2") for w in ("latin-1", "cp1252")),
    *(((r, w),) for r in ("cp1253", "iso8859-7", "cp1254") for w in ("latin-1", "cp1252")),
    *(((r, w),) for r in ("euc_jp", "shift_jis", "gbk", "big5", "euc_kr") for w in ("latin-1", "cp1252")),
    *(((r, w),) for r, w in (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp850", "latin-1"), ("cp437", "latin-1"), ("cp1252", "cp1251"), ("cp1252", "cp850"), ("cp1252", "koi8-r"), ("cp1252", "cp1250"), ("cp1252", "cp1253"))),
]
_BUCKETS = 1 << 14
_PRIOR_CLEAN = 0.9
_WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
_REPLACED = "�"


@cache
def _charmap(name: str) -> tuple[dict[str, int], list[str]]:
    """A single-byte encoding with undefined bytes kept as C1 controls, as lenient decoders do."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


def _garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for right, wrong in chain:
        try:
            text = "".join(_charmap(wrong)[1][b] for b in text.encode(right))
        except UnicodeEncodeError:
            return None
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain of wrong decodings, or None unless every step is strictly decodable."""
    for right, wrong in reversed(chain):
        table = _charmap(wrong)[0]
        try:
            text = bytes([table[c] for c in text]).decode(right)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _features(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.int64)
    pair = b[:-1] * 256 + b[1:]
    pair = pair[(b[:-1] > 127) | (b[1:] > 127)]
    return (pair * 2654435761 >> 7) % _BUCKETS


def _record(text: str) -> str:
    return " ".join(_WORD.findall(text))


class ChainModel:
    """Multinomial classes: clean text, and one per chain."""

    def __init__(self) -> None:
        self.chains: list[tuple[tuple[str, str], ...] | None] = [None, *dict.fromkeys(CHAINS)]
        counts = np.full((len(self.chains), _BUCKETS), 0.02)
        clean = {_record(s) for lang in SENTENCES.values() for s in lang}
        for k, chain in enumerate(self.chains):
            for s in (x for lang in SENTENCES.values() for x in lang):
                for variant in {s, s.upper(), s.capitalize()}:
                    g = variant if chain is None else _garble(variant, chain)
                    if g and not g.isascii() and (chain is None or _record(g) not in clean):
                        np.add.at(counts[k], _features(_record(g)), 1.0 if variant == s else 0.15)
        self.log = np.log(counts / counts.sum(1, keepdims=True))
        prior = np.full(len(self.chains), (1 - _PRIOR_CLEAN) / (len(self.chains) - 1))
        prior[0] = _PRIOR_CLEAN
        self.prior = np.log(prior)

    def scores(self, text: str) -> tuple[np.ndarray, float]:
        """Log posterior of each class, and by how much the text is likelier as clean text than as noise."""
        got = self.log[:, _features(text)]
        return self.prior + got.sum(1), float((got[0] + np.log(_BUCKETS)).sum())

    def judge(self, text: str) -> tuple[tuple[tuple[str, str], ...] | None, str | None]:
        """(chain, restored text) of a record, (None, None) if it reads as it should.

        Chains are inverted from the likeliest by the classifier on: all that it prefers to clean text, and
        those of multi-byte encodings, whose strict decoding is evidence of its own. Of those strictly
        decodable the one whose result is the better text is taken, if it is better than the text as it stands.
        """
        s, here = self.scores(text)
        best, found = 0.0, (None, None)
        order = np.argsort(-s, kind="stable")
        for k in order:
            chain = self.chains[k]
            if chain and chain[-1][0] != "utf-8" and s[k] <= s[0]:  # nothing but a multi-byte result outweighs this
                continue
            back = chain and invert(text, chain)
            if not back or not plausible(back):
                continue
            there = 0.0 if back.isascii() else self.scores(back)[1]
            multibyte = chain[-1][0] == "utf-8"
            # each multi-byte character that decodes strictly is evidence of its own
            gain = 0.5 * (there - here) + float(s[k] - s[0]) + (30.0 + 4.0 * (len(text) - len(back)) if multibyte else 0.0)
            if gain > best and (multibyte and (there > here - 12 or len(text) - len(back) > 3) or s[k] > s[0] and there > here + 3 and _in_words(text, back)):
                best, found = gain, (chain, back)
        return found


def _in_words(text: str, back: str) -> bool:
    """Whether an inversion changes letters inside words, not just a sign here and there.

    Two different words must change, or three letters of one; multi-byte results change their length
    and always count.
    """
    if len(text) != len(back):
        return True
    changed = {}
    for old, new in zip(text.split(), back.split()):
        if old != new:
            n = sum(a != b and b.isalpha() and (new[i - 1 : i].isalpha() or new[i + 1 : i + 2].isalpha()) for i, (a, b) in enumerate(zip(old, new)))
            if n:
                changed[new.strip(".,;:!?\"'()")] = n
    return len(changed) > 1 or any(n > 2 for n in changed.values())


def plausible(text: str) -> bool:
    """Whether a restored text has no controls, private or unassigned characters."""
    return not re.search(r"[\x00-\x08\x0e-\x1f\x7f-\x9f-�￰-￿]", text)


@cache
def model() -> ChainModel:
    """The classifier, trained once in a process (under a second)."""
    return ChainModel()


def _by_words(line: str, m: ChainModel) -> tuple[str | None, str]:
    """(chain name or None, line with its garbled words restored)."""
    whole = _WORD.findall(line)
    chain, _ = m.judge(" ".join(whole))
    if chain is not None:
        parts = [invert(w, chain) for w in whole]
    elif len(whole) > 1:  # garbled and right words in one line
        parts, chain = [], None
        for w in whole:
            c, back = m.judge(w)
            right = c is not None and c[-1][0] == "utf-8"
            chain = chain or (c if right else None)
            parts.append(back if right else None)
    if chain is None:
        return None, line
    out = iter(p if p is not None else w for p, w in zip(parts, whole))
    return name(chain), _WORD.sub(lambda _: next(out), line)


def name(chain: tuple[tuple[str, str], ...]) -> str:
    """``utf-8>cp1252`` and the like; steps joined by a comma."""
    return ",".join(f"{a}>{b}" for a, b in chain)


def _listed(line: str) -> bool:
    """Whether a line holds a garbled sequence beside its repaired form, as tables of repairs do."""
    runs = set(_RUN.findall(line))
    if len(runs) < 2:
        return False
    for run in runs:
        for chain in CHAINS:
            if chain[-1][0] == "utf-8" and len(run) > 1:
                back = invert(run, chain)
                if back and back != run and back in runs:
                    return True
    return False


def repair(text: str) -> tuple[str | None, int, int, str]:
    """(chain or 'lost', garbled lines, restored lines, restored text) of one content.

    Lines with replacement characters are garbled for good. Lines that list a garbled sequence beside
    its repaired form are left alone.
    """
    if text.isascii():
        return None, 0, 0, text
    m = model()
    lines = text.split("\n")
    chain, bad, good = None, 0, 0
    for i, line in enumerate(lines):
        if line.isascii():
            continue
        if _REPLACED in line:
            if not re.search(r"['\"(]\?�['\")]", line):
                bad += 1
                chain = chain or "lost"
            continue
        c, back = _by_words(line, m)
        if c is not None and not _listed(line):
            bad += 1
            good += 1
            chain = c if chain in (None, "lost") else chain
            lines[i] = back
    return chain, bad, good, "\n".join(lines) if good else text


_SCHEMA = "repo_path string, path string, chain string, garbled_lines int, restored_lines int, content string"


def _judge(repos: list, paths: list, contents: list) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in ("repo_path", "path", "chain", "garbled_lines", "restored_lines", "content")}
    for repo, path, text in zip(repos, paths, contents):
        chain, bad, good, fixed = repair(text)
        if bad:
            for n, x in (("repo_path", repo), ("path", path), ("chain", chain), ("garbled_lines", bad), ("restored_lines", good), ("content", fixed if good else None)):
                out[n].append(x)
    return out


def garbled_files(sources: DataFrame) -> DataFrame:
    """Files with at least one garbled line: chain, counts, and the restored content (null where nothing can be had).

    ``encoding`` is not consulted. Null and plain ASCII contents are skipped in the JVM before any
    Python runs. Null keys are kept; repeated rows that agree fold into one.
    """
    wanted = sources.select("repo_path", "path", "content").filter(F.col("content").rlike(r"[^\x00-\x7f]"))
    return map_columns(spread(wanted), ["repo_path", "path", "content"], _judge, _SCHEMA)
