"""Fixed values of the domain: unit prefixes, labels, ranks, substitutes, notes, the hardware kit and link bases."""

from __future__ import annotations

SI = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9}

CORE_PREFIXES = ["R", "C", "D", "Q", "U", "IC", "SW", "X", "Y", "J"]
CLASSIFIER_PREFIXES = [*CORE_PREFIXES, "OP", "TL", "LDR", "LED"]
PDF_PREFIXES = [*CORE_PREFIXES, "POT", "VR", "L", "LD"]

TAPERS = {"A": "Logarithmic", "B": "Linear", "C": "Reverse Log", "W": "W Taper", "G": "Graphic"}

SWITCH_LABELS = "LENGTH MODE CLIP VOICE BRIGHT FAT PV RANGE LO HI MID".split()
POT_PREFIXES = "POT TRIM VR VOL".split()
POT_NAMES = """VOLUME TONE GAIN DRIVE DIST FUZZ DIRT LEVEL MIX BLEND BALANCE DRY WET SPEED RATE DEPTH INTENSITY WIDTH
DECAY ATTACK RELEASE SUSTAIN COMP THRESH TREBLE BASS MID MIDS PRESENCE CONTOUR EQ BODY BIAS BOOST MASTER PRE POST
FILTER SENS SWEEP RES RESONANCE AMT AMOUNT DISTORTION OCTAVE AMPLITUDE CLEAN""".split()
POT_LABELS = [*POT_PREFIXES, *POT_NAMES]
KEYWORD_EXTRAS = "COLOR TEXTURE NATURE THROB SWELL PULSE REPEATS TIME FEEDBACK CUT".split()
KEYWORDS = sorted({*POT_NAMES, *SWITCH_LABELS, *KEYWORD_EXTRAS})

IGNORE_VALUES = [
    *"TP,TPOINT,TEST POINT,TEST,PROBE,FID,FIDUCIAL,MARK,ALIGN,MARKER,MH,HOLE,MOUNTING HOLE,MTG,DRILL,SCREW HOLE".split(","),
    *"JP,JUMPER,SJ,SOLDER JUMPER,LINK,WIRE,BRIDGE,IO,PAD,VIA".split(","),
    *"DNP,DNI,NM,NC,NO POP,DO NOT POPULATE,NOT MOUNTED,OPT,OPTIONAL,OMIT,UNUSED".split(","),
    *"PCB,BOARD,PANEL,FACEPLATE,LOGO,GRAPHIC,ART,SILKSCREEN,TEXT,LABEL,ROHS,LEAD FREE,PB-FREE,UL,FCC,CE,TRASH BIN".split(","),
    *"GND,AGND,DGND,PGND,EARTH,VCC,VDD,VSS,VEE,VREF,VB,VA,+9V,+18V,-9V,+5V,+3V3".split(","),
    *"BIAS,NOTE,INFO,COMMENT,DESC,DESCRIPTION,DIP,DIP8,DIP14,DIP16,SOIC,SOIC8,PACKAGE,PKG".split(","),
]
TITLE_IGNORE = ["PEDALPCB", "CONTROLS", "REVISION", "COPYRIGHT", "WWW.PEDALPCB.COM", "LEVEL", "VCC", "GND"]
SAFE_WORDS = ["RESISTORS", "CAPACITORS", "TRANSISTORS", "DIODES", "POTENTIOMETERS", "PCB", "COMPONENT LIST", "SOCKET"]
NO_SOCKET = ["REGULATOR", "L78L", "MODULE", "BTDR", "REVERB"]
SOCKET = ("Hardware/Misc", "DIP SOCKET (Check Size)")

CATEGORIES = ["PCB", "ICs", "Crystals/Oscillators", "Optoelectronics", "Transistors", "Diodes", "Potentiometers", "Switches", "Capacitors", "Resistors", "Hardware/Misc"]
Z_HEIGHT = {"PCB": 0, "Resistors": 10, "Diodes": 15, "Crystals/Oscillators": 30, "Transistors": 50, "Switches": 70, "Potentiometers": 80, "Hardware/Misc": 85, "ICs": 90}
Z_SOCKET, Z_SMALL_CAP, Z_LARGE_CAP, Z_OTHER = 18, 40, 60, 99

IC_SUBSTITUTES = {
    "TL072": [("OPA2134", "Hi-Fi / Studio Clean", "Low distortion (0.00008%), High Slew Rate (20V/us)"), ("TLC2272", "High Headroom Clean", "Rail-to-Rail output (+6Vpp headroom on 9V)")],
    "JRC4558": [("NJM4558D", "Vintage Correct", "Authentic 1980s BJT bandwidth limiting"), ("OPA2134", "Modern/Clinical", "High impedance input, removes 'warm' blur")],
    "LM308": [("LM308N", "Vintage RAT", "Required for 0.3V/us slew-induced distortion"), ("OP07", "Modern Tight", "Faster slew rate, sounds harsher/tighter than vintage")],
    "NE5532": [("OPA2134", "Lower Noise", "JFET input reduces current noise with high-Z guitars")],
}
DIODE_SUBSTITUTES = {
    "1N4148": [("1N4001", "Smooth / Tube-like", "Slow reverse recovery (30µs) smears highs"), ("IR LED", "The 'Goldilocks' Drive", "1.2V drop: More crunch than LED, more headroom than Si"), ("Red LED", "Amp-like / Open", "1.8V drop: Huge headroom, loud output")],
    "1N914": [("1N4001", "Smooth / Tube-like", "Slow reverse recovery (30µs) smears highs")],
    "1N34A": [("BAT41", "Modern Schottky", "Stable alternative, slightly harder knee"), ("1N60", "Alt Germanium", "Different Vf variance")],
}


def substitutes(table: dict[str, list[tuple[str, str, str]]]) -> dict[str, str]:
    """Part -> its suggestion text."""
    return {k: "💡 TRY: " + ", ".join(f"{name} ({profile}: {why})" for name, profile, why in v) for k, v in table.items()}


NOTES = {
    "resistor": "Use 1/4W Metal Film (1%)",
    "resistor_low": "⚠️ Suspicious Value (< 1Ω). Verify BOM.",
    "bypass": "Power filtering (buy bulk).",
    "cap_high": "⚠️ Suspicious Value (> 10mF).",
    "cap_1u": "Rec: Box Film (Check BOM: Could be Electrolytic)",
    "cap_mlcc": "Rec: Class 1 Ceramic (C0G / NP0)",
    "cap": "Rec: ",
    "obsolete": "⚠️ Obsolete part! Check for speciality vendors or consider MMBF5457.",
    "smd": "SMD Part! Verify PCB pads or buy adapter.",
    "ic": "Socket Recommended",
    "crystal": "Heat sensitive / Fragile",
    "adapter": "[AUTO] Verify PCB pads.",
    "socket": "[AUTO] For chip safety.",
    "pcb": "Main Board",
    "standard": "🤖 Standard Part: ",
}

#: (category, value, quantity a project, note)
HARDWARE = [
    ("Resistors", "3.3k", 1, "LED CLR"),
    ("Diodes", "LED", 1, "Status Light"),
    ("Hardware/Misc", "1590B Enclosure", 1, "Verify PCB fit"),
    ("Hardware/Misc", "3PDT FOOTSWITCH PCB", 1, "Wiring Board"),
    ("Hardware/Misc", "3PDT STOMP SWITCH", 1, "Blue/Standard"),
    ("Hardware/Misc", "6.35MM JACK (STEREO)", 1, "Input"),
    ("Hardware/Misc", "6.35MM JACK (MONO)", 1, "Output"),
    ("Hardware/Misc", "DC POWER JACK 2.1MM", 1, "Center Negative"),
    ("Hardware/Misc", "Bezel LED Holder", 1, "3mm Metal"),
    ("Hardware/Misc", "Rubber Feet (Black)", 4, "Enclosure Feet"),
    ("Hardware/Misc", "AWG 24 Hook-Up Wire", 3, "Approx 1ft/pedal"),
    ("Hardware/Misc", "9V BATTERY CLIP", 1, "Optional"),
    ("Hardware/Misc", "Heat Shrink Tubing", 1, "Insulation"),
]
GERMANIUM = ("Transistors", "Germanium PNP", "Vintage Option")
POT_HARDWARE = [("Knob", "Knobs"), ("Dust Seal Cover", "Pot Seals")]
AUTO_SOURCE = "Auto-Inject"

TAYDA = "https://www.taydaelectronics.com/catalogsearch/result/?q="
PEDALPCB = ("https://www.pedalpcb.com/?product_cat=&s=", "&post_type=product")
