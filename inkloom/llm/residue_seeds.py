"""Independent training sentences of the residue classes, in the wording of this library.

They only keep the models from being blind where a labelled sample holds no
residue; what a collection shows itself is learnt from that sample.
"""

from __future__ import annotations

import random

#: What a site says in place of an article.
NOTICES = """
您要访问的页面已经不在了|没有找到您想看的文章|作者已经把这篇内容删掉了|因投诉暂不展示该内容|服务出现故障，请过一会儿再来|程序出错，我们正在抢修|网站升级中，稍后恢复服务|为了账号安全，请先拖动滑块|请证明您是真人用户|检测到异常流量，请输入图中字符|您无权浏览此栏目|需要打开浏览器脚本才能浏览|页面内容载入中，请耐心等候|马上为您转到新地址
We looked everywhere but the requested page is missing|Nothing lives at this address any more|Its author took this article down|Hidden after a complaint about the content|Our server ran into a problem while handling the request|Sorry for the hiccup, our engineers are on it|Down for planned maintenance, back soon|Prove you are not a machine by solving this puzzle|Suspicious activity detected, complete the challenge|You lack the rights to see this section|Turn scripting on in your browser settings to read this site|Content is being loaded, hang on a moment|Taking you to the new address in a second
Unter dieser Adresse liegt keine Seite|Der Autor hat den Artikel zurückgezogen|Beim Verarbeiten der Anfrage ging etwas schief|Wegen Wartung vorübergehend geschlossen|Lösen Sie das Rätsel, um fortzufahren|Schalten Sie Skripte in Ihrem Browser ein|Der Inhalt wird gerade aufgebaut, einen Augenblick|Wir leiten Sie zur neuen Adresse um
Aucune page à cette adresse|L’auteur a retiré son texte|Un problème a empêché le traitement de la demande|Fermé pour entretien, revenez plus tard|Résolvez l’énigme pour continuer la visite|Autorisez les scripts dans votre navigateur|Le contenu arrive, patientez un moment|Nous vous emmenons vers la nouvelle adresse
No hay ninguna página en esta dirección|El autor retiró su texto|Un fallo impidió atender la petición|Cerrado por mantenimiento, vuelva más tarde|Resuelva el acertijo para seguir|Permita los scripts en su navegador|El contenido está llegando, un momento|Le llevamos a la nueva dirección
"""

#: What stands where an author has not written yet.
PLACEHOLDERS = """
文章内容稍后补上|这一段请自行替换|请在此编写您的文章|样例标题，样例正文|仅供调试使用的假数据
Put your own words in this box|This paragraph is only here to fill space|Example heading, example body|Only a trial post, nothing to see|Replace before publishing
Dieser Absatz dient nur als Füllung|Bitte durch eigenen Inhalt ersetzen|Nur ein Probebeitrag
Ce paragraphe ne sert qu’à remplir|À remplacer par votre propre contenu|Simple article d’essai
Este párrafo solo sirve de relleno|Cámbielo por su propio contenido|Solo una entrada de ensayo
"""

#: What a collector reports of its own work.
COLLECTOR = """
socket closed before the answer was complete|gave up after five attempts to connect|no answer within the deadline|host name could not be resolved|certificate of the host was not accepted|gateway of the crawler unreachable|sign in expired, ask for fresh credentials|cookies of this account are stale|thread pool has no free worker|job was dropped from the waiting list|quota of worker 7 is used up|throttled by the host, paused too long|no room left on the storage device|saving the picture was interrupted|body of the answer was empty|no known container in the markup|extractor returned zero characters|only the free teaser was stored|answered from the stored copy of last month|stopped by the operator|checksum of the download differs
对端提前关闭了套接字|尝试五次仍无法建立连接|超过期限没有应答|主机名无法解析到地址|登录信息失效，需要换新的账户|线程池没有空闲的工作线程|作业已从等待队列移除|被限流，暂停过久后停止|存储设备空间用尽|保存图片时被打断|应答主体为空|标记中没有已知的容器|提取结果为零个字符|只存了免费的试读|读取了上个月的存档副本|操作员停止了任务
Sitzung abgelaufen, Anmeldung erneuern|Zeitüberschreitung beim Verbinden|Kein Speicherplatz mehr auf dem Datenträger|Leere Antwort erhalten|Auftrag aus der Warteschlange entfernt|Drosselung, zu lange gewartet|nur Vorschau gespeichert|aus altem Zwischenspeicher gelesen
Session expirée, identifiants à renouveler|Délai de connexion dépassé|Plus de place sur le support|Réponse sans contenu|Tâche retirée de la file|Débit limité, attente abandonnée|seul l’extrait gratuit est enregistré
Sesión caducada, renueve las credenciales|Tiempo de conexión agotado|Sin espacio en la unidad|Respuesta sin contenido|Tarea retirada de la cola|Límite de peticiones, espera abandonada|solo se guardó el adelanto gratuito
"""

_KEYS = "colour widget gadget vendor basket invoice parcel region".split()
_FRAMES = ("{{{{{a}}}}}", "{{{{ {a} }}}}", "{{{{ {a}.{b} }}}}", "{{% {a} %}}", "<%= {a} %>", "%({a})s", "%%{A}%%", "@{a}@", "[{a}:{b}]", "[%{a}%]", "${{{a}}}", "#{{{a}}}", "{{{a}}}", "{{${a}}}", "__{A}__", "[[{a}]]", "<?= ${a} ?>")


def _split(text: str) -> list[str]:
    return [x.strip() for line in text.strip().splitlines() for x in line.split("|") if x.strip()]


def collector() -> list[str]:
    return _split(COLLECTOR)


def residue(seed: int = 5) -> list[str]:
    """Notices, placeholders, and template expressions of many engines with made-up names."""
    rng = random.Random(seed)
    out = _split(NOTICES) + _split(PLACEHOLDERS)
    for frame in _FRAMES:
        for _ in range(3):
            a, b = rng.choice(_KEYS), rng.choice(_KEYS)
            out.append(frame.format(a=a, b=b, A=a.upper(), B=b.upper()))
    return out
