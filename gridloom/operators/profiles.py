"""Brochure layouts that are known.  A line of options is its pattern or code
and kind, then its name; long descriptions aren't kept."""

from __future__ import annotations

from .model_year import Profile, Spec


def _fixed(lines: str) -> tuple[Spec, ...]:
    return tuple(Spec(name, pattern=pattern) for pattern, name in (x.strip().split(" ", 1) for x in lines.strip().splitlines()))


def _coded(lines: str) -> tuple[Spec, ...]:
    out = []
    for line in lines.strip().splitlines():
        head, name, *rest = (x.strip() for x in line.split("|"))
        code, kind, *marks = head.split()
        marker = next((m for m in marks if m != "+"), "")
        out.append(Spec(name, {"o": "OPTION", "w": "WHEEL", "a": "ACCESSORIES", "u": "UPHOLSTERY"}[kind], code, description=rest[0] if rest else "", marker=marker, merge="+" in marks))
    return tuple(out)


_STANDARD = _fixed("""
    SSNNNNSNN Elektromosan állítható, fűthető külső tükrök
    SSSSSSSSS Első lökhárító világító Vizorral
    SSSSSSSSS Fekete övvonal
    SSNNNNSNN Hővisszaverő ablaküvegek, sötétítés nélkül
    SSSSSSSSS Vonóhorog-előkészítés
    SSSSSSSSS LED világítás a napellenzőben
    SSSSSSSSS ISOFIX Top Tether rögzítőpont a hátsó szélső üléseken
    SSSSSSSSS 60:40 arányban lehajtható hátsó üléssor
    SSNNNNSNN Középkonzol pohártartókkal és tárolórekesszel
    SSSSNNSSN Bőrhatású kormánykerék
    SSNNNNSNN Automata légkondicionáló
    SSSSSSSSS LED világítás a csomagtérben
    SSSSNNSSN Fix csomagtérpadló
    SSNNNNSNN Multimedia infotainment
    SSSSSSSSS Elektromos rögzítőfék
    SSNNNNSNN Lebillenthető belső visszapillantó tükör
    SSSSSSSSS OpelConnect okosautó-rendszer
    SSSSNNSSN Adaptív LED fényszórók
    SSSSSSSSS Automatikus fényszóró és távolsági fényszóró kapcsolás esőérzékelővel
    SSSSSSSSS Két kulcs távvezérlővel, kivehető tollal
    SSNNNNSNN Kulcs nélküli indítás
    SSSSSSSSS Adaptív sebességtartó csomag
    SSSSSSSSS Vezetői-éberségfigyelő kamera az A-oszlopon
    SSNNNNSNN Parkolóradar elöl és hátul
    SSSSSSSSS Első légzsákok, oldal- és függönylégzsákok, vezetőoldali térdlégzsák
    NNNNNNSSS 3,3 kW teljesítményű, egyfázisú fedélzeti töltőegység
    NNSSSSNSS Karbon fekete tetőszín
    NNSSSSNSS Elektromosan állítható és behajtható, fűthető külső tükrök
    NNSSSSNSS Hővisszaverő ablaküvegek, sötétített hátsó és hátsó oldalsó ablakok
    NNSSSSNSS Középkonzol kartámasszal, pohártartókkal, tárolórekesszel és 2 USB-C port 15W gyorstöltéssel
    NNSSSSNSS Kétzónás automata légkondicionáló
    NNSSSSNSS LED hangulatvilágítás az első ajtókban, 8 színben állítható
    NNSSNNNSN Multimedia pro infotainment
    NNSSSSNSS Fényérzékeny belső tükör, keret nélkül
    NNSSSSNSS Kulcs nélküli nyitás és indítás
    NNSSSSNSS 180 fokos tolatókamera, parkolóradar elöl és hátul
""")
_KADET = _coded('DZHYF w + | 17" Kadet könnyűfém keréktárcsák')
_INTELLIDRIVE = _fixed("NNNNSSNNS IntelliDrive 1.0")
_MIDDLE = _coded("""
    DZHZI w | 18" Pentagon könnyűfém keréktárcsák
    DJD00 o | Tető a karosszéria színében
    DTC07 o | Panoráma napfénytető
    DAQ05 o | Vonóhorog
    DE301 o | Vezeték nélküli telefontöltő
    DVH62 o | GS Komfort csomag
    DLZ02 o | 7,4 kW teljesítményű, egyfázisú fedélzeti töltőegység | Plug-in hybrid esetén
    DNG39 a | Mode 2 töltőkábel T2-E/F 6m | Plug-in hybrid esetén
    DZHYD w | 16" Admiral könnyűfém keréktárcsák
    DZHYH w | 18" Pentagon könnyűfém keréktárcsák
    DMI19 w Phantom | 16" Phantom könnyűfém keréktárcsák
    DMI19 w Admiral | 16" Admiral könnyűfém keréktárcsák
    DRS19 o | Pótkerék előkészítés
    DLV03 o | Kerékjavító készlet
""")
_TRAILING = _coded("""
    DZJG3 o | Multimedia pro Navi infotainment csomag
    BPFX u | Malawa kárpit újrahasznosított anyagból, szövet, fekete/szürke
    DWAFY o | Edition AGR csomag
    FYFX u | Bird kárpit újrahasznosított anyagból, szövet, fekete/szürke
    F4FX u | Guilford kárpit, bőrhatású / velúr, fekete
    DVD09 o | Edition Komfort csomag
    DWAGA o | GS Téli csomag
    DZJG9 o | Multimedia Navi infotainment csomag
    DYD07 o | Edition technológia csomag
    DLA11 o | GS Technológia csomag
""")
_PAINT = {"alap": "alapfényezés", "metál": "metálfényezés", "gyöngy": "gyöngyház fényezés"}
_COLOURS = tuple(
    (name, _PAINT[paint], 1000.0 * price)
    for name, paint, price in [
        ("Arktis fehér", "alap", 200), ("Athletik kék", "metál", 0), ("Kristall ezüst", "metál", 220), ("Kontur fehér", "metál", 220),
        ("Grafik szürke", "alap", 200), ("Kult sárga", "metál", 220), ("Karbon fekete", "gyöngy", 220),
    ]
)
_CHARGERS = tuple((f"{n} autótöltő", "TÖLTŐBERENDEZÉS", p) for n, p in [("STILO", 419_900.0), ("WALLBOX DUO", 999_900.0), ("VERTICA DUO", 1_999_900.0)])

ASTRA = Profile(
    "opel-astra-my26", tuple("listaarak es kedvezmenyes arak|standard felszereltseg|edition|ultimate|dzjg9|my26b".split("|")), ("Edition", "GS", "Ultimate"), 9,
    _STANDARD + _KADET + _INTELLIDRIVE + _MIDDLE, _COLOURS, _CHARGERS, _TRAILING,
)
PROFILES = (ASTRA,)
