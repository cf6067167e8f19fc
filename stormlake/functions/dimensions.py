"""Fixed dimensions: radar sites and notable loops, as tables to broadcast."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public station list; site, latitude, longitude, height in metres.
SITES = """
KABR 45.455833 -98.413333 422.0
KABX 35.149722 -106.823880 1814.0
KAKQ 36.984050 -77.007361 78.0
KAMA 35.233333 -101.709270 1129.0
KAMX 25.611083 -80.412667 34.0
KAPX 44.906350 -84.719533 476.0
KARX 43.822778 -91.191111 414.0
KATX 48.194611 -122.495690 196.0
KBBX 39.495639 -121.631610 67.0
KBGM 42.199694 -75.984722 519.0
KBHX 40.498583 -124.292160 767.0
KBIS 46.770833 -100.760550 535.0
KBLX 45.853778 -108.606800 1129.0
KBMX 33.172417 -86.770167 231.0
KBOX 41.955778 -71.136861 71.0
KBRO 25.916000 -97.418967 27.0
KBUF 42.948789 -78.736781 241.0
KBYX 24.597500 -81.703167 27.0
KCAE 33.948722 -81.118278 105.0
KCBW 46.039250 -67.806431 262.0
KCBX 43.490217 -116.236030 967.0
KCCX 40.923167 -78.003722 758.0
KCLE 41.413217 -81.859867 262.0
KCLX 32.655528 -81.042194 70.0
KCRI 35.238333 -97.460000 401.0
KCRP 27.784017 -97.511250 43.0
KCXX 44.511000 -73.166431 131.0
KCYS 41.151919 -104.806030 1888.0
KDAX 38.501111 -121.677830 44.0
KDDC 37.760833 -99.968889 814.0
KDFX 29.273139 -100.280330 365.0
KDGX 32.279944 -89.984444 186.0
KDIX 39.947089 -74.410731 70.0
KDLH 46.836944 -92.209722 470.0
KDMX 41.731200 -93.722869 334.0
KDOX 38.825767 -75.440117 50.0
KDTX 42.700000 -83.471667 371.0
KDVN 41.611667 -90.580833 259.0
KDYX 32.538500 -99.254333 482.0
KEAX 38.810250 -94.264472 333.0
KEMX 31.893650 -110.630250 1621.0
KENX 42.586556 -74.064083 590.0
KEOX 31.460556 -85.459389 164.0
KEPZ 31.873056 -106.698000 1286.0
KESX 35.701350 -114.891650 1508.0
KEVX 30.565033 -85.921667 67.0
KEWX 29.704056 -98.028611 234.0
KEYX 35.097850 -117.560750 876.0
KFCX 37.024400 -80.273969 904.0
KFDR 34.362194 -98.976667 401.0
KFDX 34.634167 -103.618880 1432.0
KFFC 33.363550 -84.565950 296.0
KFSD 43.587778 -96.729444 456.0
KFSX 34.574333 -111.198440 2290.0
KFTG 39.786639 -104.545800 1710.0
KFWS 32.573000 -97.303150 237.0
KGGW 48.206361 -106.624690 727.0
KGJX 39.062169 -108.213760 3079.0
KGLD 39.366944 -101.700270 1133.0
KGRB 44.498633 -88.111111 251.0
KGRK 30.721833 -97.382944 184.0
KGRR 42.893889 -85.544889 267.0
KGSP 34.883306 -82.219833 326.0
KGWX 33.896917 -88.329194 180.0
KGYX 43.891306 -70.256361 144.0
KHDC 30.519300 -90.407400 13.0
KHDX 33.077000 -106.120030 1301.0
KHGX 29.471900 -95.078733 35.0
KHNX 36.314181 -119.632130 104.0
KHPX 36.736972 -87.285583 187.0
KHTX 34.930556 -86.083611 567.0
KICT 37.654444 -97.443056 427.0
KICX 37.591050 -112.862180 3279.0
KILN 39.420483 -83.821450 357.0
KILX 40.150500 -89.336792 223.0
KIND 39.707500 -86.280278 270.0
KINX 36.175131 -95.564161 228.0
KIWA 33.289233 -111.669910 435.0
KIWX 41.358611 -85.700000 322.0
KJAX 30.484633 -81.701900 49.0
KJGX 32.675683 -83.350833 188.0
KJKL 37.590833 -83.313056 445.0
KLBB 33.654139 -101.814160 1030.0
KLCH 30.125306 -93.215889 42.0
KLGX 47.116944 -124.106660 112.0
KLIX 30.336667 -89.825417 55.0
KLNX 41.957944 -100.576220 949.0
KLOT 41.604444 -88.084444 232.0
KLRX 40.739550 -116.802700 2102.0
KLSX 38.698611 -90.682778 220.0
KLTX 33.989150 -78.429108 44.0
KLVX 37.975278 -85.943889 254.0
KLWX 38.976111 -77.487500 123.0
KLZK 34.836500 -92.262194 198.0
KMAF 31.943461 -102.189250 903.0
KMAX 42.081169 -122.717360 2305.0
KMBX 48.393056 -100.864440 485.0
KMHX 34.775908 -76.876189 44.0
KMKX 42.967900 -88.550667 312.0
KMLB 28.113194 -80.654083 45.0
KMOB 30.679444 -88.240000 88.0
KMPX 44.848889 -93.565528 336.0
KMQT 46.531111 -87.548333 465.0
KMRX 36.168611 -83.401944 437.0
KMSX 47.041000 -113.986220 2432.0
KMTX 41.262778 -112.447770 2010.0
KMUX 37.155222 -121.898440 1082.0
KMVX 47.527778 -97.325556 330.0
KMXX 32.536650 -85.789750 171.0
KNKX 32.919017 -117.041800 321.0
KNQA 35.344722 -89.873333 133.0
KOAX 41.320369 -96.366819 385.0
KOHX 36.247222 -86.562500 206.0
KOKX 40.865528 -72.863917 61.0
KOTX 47.680417 -117.626770 746.0
KOUN 35.236058 -97.462350 391.0
KPAH 37.068333 -88.771944 154.0
KPBZ 40.531717 -80.217967 386.0
KPDT 45.690650 -118.852930 482.0
KPOE 31.155278 -92.976111 144.0
KPUX 38.459550 -104.181350 1635.0
KRAX 35.665519 -78.489750 141.0
KRGX 39.754056 -119.462020 2559.0
KRIW 43.066089 -108.477300 1717.0
KRLX 38.311111 -81.722778 370.0
KRTX 45.715039 -122.965000 527.0
KSFX 43.105600 -112.686130 1383.0
KSGF 37.235239 -93.400419 419.0
KSHV 32.450833 -93.841250 118.0
KSJT 31.371278 -100.492500 611.0
KSOX 33.817733 -117.636000 947.0
KSRX 35.290417 -94.361889 225.0
KTBW 27.705500 -82.401778 37.0
KTFX 47.459583 -111.385330 1160.0
KTLH 30.397583 -84.328944 54.0
KTLX 35.333361 -97.277761 390.0
KTWX 38.996950 -96.232550 431.0
KTYX 43.755694 -75.679861 597.0
KUDX 44.124722 -102.830000 974.0
KUEX 40.320833 -98.441944 627.0
KVAX 30.890278 -83.001806 101.0
KVBX 34.838550 -120.397910 413.0
KVNX 36.740617 -98.127717 383.0
KVTX 34.412017 -119.178750 856.0
KVWX 38.260250 -87.724528 190.0
KYUX 32.495281 -114.656710 73.0
LPLA 38.730280 -27.321670 1016.0
PABC 60.791944 -161.876380 59.0
PACG 56.852778 -135.529160 83.0
PAEC 64.511389 -165.295000 27.0
PAHG 60.725914 -151.351460 109.0
PAIH 59.460767 -146.303440 40.0
PAKC 58.679444 -156.629440 44.0
PAPD 65.035114 -147.501430 825.0
PGUA 13.455833 144.811111 118.0
PHKI 21.893889 -159.552500 104.0
PHKM 20.125278 -155.777770 1209.0
PHMO 21.132778 -157.180270 440.0
PHWA 19.095000 -155.568880 445.0
RKJK 35.924167 126.622222 59.0
RKSG 37.207569 127.285561 464.0
RODN 26.307800 127.903469 126.0
TJUA 18.115667 -66.078167 902.0
"""

#: Id, site, start, end, peak and name of notable loops.
EVENTS = """
jarrell1997 | KEWX | 1997-05-27T20:00Z | 1997-05-27T21:30Z | 1997-05-27T20:40Z | Jarrell F5, 1997
moore1999 | KTLX | 1999-05-03T22:30Z | 1999-05-04T00:45Z | 1999-05-04T00:05Z | Bridge Creek-Moore F5, 1999
katrina2005 | KLIX | 2005-08-29T09:00Z | 2005-08-29T12:00Z | 2005-08-29T11:10Z | Hurricane Katrina, 2005
greensburg2007 | KDDC | 2007-05-05T01:30Z | 2007-05-05T03:00Z | 2007-05-05T02:45Z | Greensburg EF5, 2007
tuscaloosa2011 | KBMX | 2011-04-27T21:45Z | 2011-04-27T23:45Z | 2011-04-27T22:13Z | Tuscaloosa-Birmingham EF4, 2011
joplin2011 | KSGF | 2011-05-22T22:00Z | 2011-05-22T23:15Z | 2011-05-22T22:41Z | Joplin EF5, 2011
moore2013 | KTLX | 2013-05-20T19:30Z | 2013-05-20T20:45Z | 2013-05-20T20:10Z | Moore EF5, 2013
elreno2013 | KTLX | 2013-05-31T22:45Z | 2013-05-31T23:55Z | 2013-05-31T23:20Z | El Reno, 2013
harvey2017 | KCRP | 2017-08-26T00:30Z | 2017-08-26T04:00Z | 2017-08-26T03:00Z | Hurricane Harvey, 2017
michael2018 | KEVX | 2018-10-10T15:30Z | 2018-10-10T18:30Z | 2018-10-10T17:30Z | Hurricane Michael, 2018
derecho2020 | KDMX | 2020-08-10T15:30Z | 2020-08-10T17:30Z | 2020-08-10T16:45Z | Iowa derecho, 2020
ida2021 | KLIX | 2021-08-29T15:00Z | 2021-08-29T18:00Z | 2021-08-29T16:55Z | Hurricane Ida, 2021
mayfield2021 | KPAH | 2021-12-11T02:30Z | 2021-12-11T04:15Z | 2021-12-11T03:26Z | Mayfield EF4, 2021
ian2022 | KTBW | 2022-09-28T16:30Z | 2022-09-28T19:30Z | 2022-09-28T19:05Z | Hurricane Ian, 2022
buffalo2022 | KBUF | 2022-11-18T12:00Z | 2022-11-18T15:00Z | 2022-11-18T13:30Z | Buffalo lake-effect snow, 2022
rollingfork2023 | KDGX | 2023-03-25T00:30Z | 2023-03-25T01:45Z | 2023-03-25T01:02Z | Rolling Fork EF4, 2023
"""


def site_rows() -> list[tuple[str, float, float, float]]:
    return [(a, float(b), float(c), float(d)) for a, b, c, d in (x.split() for x in SITES.strip().splitlines())]


def sites(spark: SparkSession) -> DataFrame:
    """(icao, lat, lon, height_m)."""
    return spark.createDataFrame(site_rows(), "icao string, lat double, lon double, height_m double")


def location(icao: str) -> tuple[float, float, float] | None:
    return next((r[1:] for r in site_rows() if r[0] == icao), None)


def events(spark: SparkSession) -> DataFrame:
    """(id, icao, from_time, to_time, peak_time, name)."""
    rows = [tuple(p.strip() for p in x.split("|")) for x in EVENTS.strip().splitlines()]
    frame = spark.createDataFrame(rows, "id string, icao string, from_time string, to_time string, peak_time string, name string")
    return frame.withColumns({c: F.to_timestamp(c, "yyyy-MM-dd'T'HH:mmX") for c in ("from_time", "to_time", "peak_time")})


def event_scans(scans: DataFrame, loops: DataFrame) -> DataFrame:
    """Scans (icao, scan_time, name) of each loop's own window, and which of them is nearest its peak, the earlier on ties."""
    from pyspark.sql import Window

    met = scans.alias("s").join(F.broadcast(loops.alias("e")), (F.col("s.icao") == F.col("e.icao")) & F.col("s.scan_time").between(F.col("e.from_time"), F.col("e.to_time")))
    away = F.abs(F.unix_micros("s.scan_time") - F.unix_micros("e.peak_time"))
    rank = F.row_number().over(Window.partitionBy("e.id").orderBy(away, "s.scan_time"))
    return met.select(F.col("e.id").alias("id"), F.col("s.name").alias("name"), F.col("s.scan_time").alias("scan_time"), (rank == 1).alias("at_peak"))


#: Centre of the national map.
CENTER = (39.0, -98.0)


def startup_site(event_site: str | None, want: str, stored: list[str]) -> str:
    """The site to open first: the one asked for if scans of it are stored, its place is known or it is the event's, else none."""
    return want if want and (want in stored or location(want) is not None or want == event_site) else ""


def view_context(name: str | None, at: datetime | None, place: tuple[float, float] | None, overview: bool, now: datetime) -> tuple[datetime, tuple[float, float]] | None:
    """(time, centre) that overlays are asked for: the national map's now, or the shown volume's own; None without either."""
    if overview:
        return now, CENTER
    return (at, place) if name is not None and at is not None and place is not None else None
