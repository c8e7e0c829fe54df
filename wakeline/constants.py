"""Area, station lists, class exclusions and thresholds. Results depend on them exactly."""

# Area of focus, closed ring in (lon, lat) order.
FOCUS_AREA = [
    (13.627332698482832, 46.01607627362711),
    (11.827331194451205, 45.56839707274841),
    (12.206288202161488, 44.06768319786181),
    (13.437866762923107, 43.47479960302897),
    (14.06942488652328, 42.20912261569302),
    (16.364148350192465, 43.688312063316346),
    (14.522085391698596, 44.50473436137818),
    (13.627332698482832, 46.01607627362711),
]

ANTENNA_LAT = 43.58693627326397
ANTENNA_LON = 13.51656777958965

# Aids to navigation (physical, virtual, mobile) of Italy, Croatia and Slovenia.
EXCLUDED_PREFIXES = [
    "992471", "992476", "992478",
    "992381", "992386", "992388",
    "992781", "992786", "992788",
]

# Shore stations that report as vessels.
EXCLUDED_MMSI = [
    0,
    2470017, 2470018, 992467018, 2470059, 2470058, 2470020,
    2780202,
    2386240, 2386300, 2386010, 2386020, 2386260, 2386190, 2386030, 2386080,
]

# The machine-learning preparation keeps MMSI 0.
EXCLUDED_MMSI_ML = [m for m in EXCLUDED_MMSI if m != 0]

# Flags of the states around the covered sea and a few common registers (ITU maritime
# identification digits). The full ITU list has about 350 codes: pass it as a file or a
# DataFrame, see wakeline.sources.dimensions.
LOCAL_FLAGS = [
    ("201", "Albania"),
    ("215", "Malta"), ("229", "Malta"), ("248", "Malta"), ("249", "Malta"), ("256", "Malta"),
    ("237", "Greece"), ("239", "Greece"), ("240", "Greece"), ("241", "Greece"),
    ("238", "Croatia"),
    ("247", "Italy"),
    ("262", "Montenegro"),
    ("278", "Slovenia"),
    ("351", "Panama"), ("352", "Panama"), ("371", "Panama"),
    ("636", "Liberia"), ("637", "Liberia"),
]

UNKNOWN = "Unknown"

BEARING_SECTOR = (180.0, 270.0)

EXCLUDED_CLASSES = [11, 19]
CLASS_SAMPLE_ROWS = 30000
TRAIN_FRACTION = 0.8
CLUSTER_SAMPLE_ROWS = 100000
MEANSHIFT_SAMPLE_ROWS = 5000

FEATURES = ["Latitude", "Longitude", "Distance", "Bearing"]
CLUSTER_FEATURES = ["Easting", "Northing", "Distance", "Bearing"]

HISTOGRAM_BINS = {"Longitude": 180, "Latitude": 180, "Distance": 1000, "Bearing": 360}

SMALL_TRACK_ROWS = 10
TRACK_SIZE_THRESHOLDS = [5, 10, 20, 30, 100]

# (unit, seconds per unit, thresholds in that unit)
GAP_THRESHOLDS = [
    ("seconds", 1, [300, 600, 1200, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800, 604800, 2592000]),
    ("minutes", 60, [5, 10, 20, 30, 60, 120, 180, 360, 720, 1440, 2880, 10080, 43200]),
    ("hours", 3600, [1, 2, 3, 6, 12, 24, 48, 168, 720]),
]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

YEARS = [2020, 2021, 2022, 2023]
TEST_START = "2023-01-01"
SEASON_WEEKS = 52
ROWS_PER_FILE = 40000

#: The port zones of the covered sea as closed (longitude, latitude) rings.
PORT_ZONES = {
    "porto commerciale": [
        (13.504509281247067, 43.61303229602851), (13.50444886853657, 43.61329028467097), (13.5049624971183, 43.61392946547258),
        (13.504946191446976, 43.61439240170344), (13.504758676249935, 43.61484046298213), (13.504298041094728, 43.61526544846015),
        (13.504440715700298, 43.61575240729442), (13.50582672524817, 43.61729562313022), (13.50570443272889, 43.61741662130518),
        (13.505965323436016, 43.617561228561215), (13.505133734306867, 43.61843328430052), (13.50550061186459, 43.61888775539188),
        (13.507918410553884, 43.618566084649416), (13.508215989017117, 43.61975537248219), (13.50848503255969, 43.61988816991146),
        (13.508608225374275, 43.62038987619593), (13.506703519544743, 43.62061684667057), (13.50674767840917, 43.62083693122386),
        (13.506484423640273, 43.62086766922522), (13.506498010982767, 43.62091316143949), (13.507431371205627, 43.620780765815255),
        (13.507505046117672, 43.62110839339081), (13.509068006745451, 43.62092743652022), (13.509233775297247, 43.62152744931541),
        (13.509141208059816, 43.62218403387487), (13.507669991905885, 43.622066120782875), (13.507522870289904, 43.62239323395272),
        (13.508715606243783, 43.6229637759196), (13.508510686850144, 43.623233830563066), (13.506760205902992, 43.62394203082408),
        (13.506973813958155, 43.6248902280833), (13.506226764728183, 43.62495413047563), (13.505621456831989, 43.62462733374096),
        (13.504527288756037, 43.623128093959224), (13.50358943040385, 43.62349583547979), (13.504624982333553, 43.62507992708237),
        (13.504410056462177, 43.62516478795442), (13.5008002817913, 43.62487157919165), (13.497661084556142, 43.62572501974131),
        (13.494026411994355, 43.62549293021135), (13.49072313165675, 43.62820625240431), (13.484487866532731, 43.621005251042675),
        (13.489637349559615, 43.615665180034284), (13.490945596598635, 43.61604806883244), (13.493450750504138, 43.61945365665014),
        (13.493283740243953, 43.62019923297919), (13.495454873628177, 43.622395606805895), (13.496178584755597, 43.619776069169916),
        (13.498433223270837, 43.6200984799616), (13.497987862576082, 43.622456056327024), (13.49876724379115, 43.622234407785015),
        (13.499296109615045, 43.620400738507925), (13.50263631482241, 43.61764005400991), (13.5016899233471, 43.6170153559907),
        (13.50271981995246, 43.61600776486324), (13.501355902825765, 43.61512107070553), (13.501876311172708, 43.613102692454675),
        (13.504509281247067, 43.61303229602851),
    ],
    "porto Marina Dorica": [
        (13.481774376708785, 43.60725294555081), (13.49036836767985, 43.60691998305424), (13.495961055305145, 43.60820943126123),
        (13.50015666103917, 43.61046252809024), (13.490072293087792, 43.615440113472914), (13.48947288289125, 43.61566825442378),
        (13.489207389334354, 43.61562150746752), (13.488925394681871, 43.614489634272616), (13.488168614442799, 43.61392642457611),
        (13.485863577387647, 43.61210264232349), (13.484312663433712, 43.61162415328829), (13.481895256305194, 43.61140868842091),
        (13.480332884385035, 43.61153471670434), (13.479846085258743, 43.611037462191206), (13.480781218824745, 43.60802950173462),
        (13.48073026435597, 43.607944643479755), (13.480714978015328, 43.6074748463389), (13.480971448839227, 43.60733218470105),
        (13.481774376708785, 43.60725294555081),
    ],
    "Fincantieri": [
        (13.505189782584836, 43.625339842782125), (13.506093727335838, 43.627629973726215), (13.502772712926173, 43.62842652055886),
        (13.502812014871836, 43.62892435696901), (13.50153470163798, 43.629251504365016), (13.500473549104413, 43.6300907004115),
        (13.499078330033683, 43.629251504365016), (13.497683110961532, 43.62590882755987), (13.500846917588603, 43.62509802262102),
        (13.503224685301689, 43.62532561809374), (13.505189782584836, 43.625339842782125),
    ],
}
