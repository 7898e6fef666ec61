"""Word lists of the semantic predicates, all in lower case.

Every list is a default: ``predicates.build`` takes others by name, for
example terms read from a table.
"""

from __future__ import annotations

# Incorporated places of New York State, by rank of size.
CITIES = [
    term.strip().lower()
    for term in """
New York, Buffalo, Rochester, Yonkers, Syracuse, Albany, New Rochelle, Mount Vernon, Schenectady, Utica,
White Plains, Hempstead, Troy, Niagara Falls, Binghamton, Freeport, Valley Stream, Long Beach, Spring Valley, Rome,
Ithaca, North Tonawanda, Poughkeepsie, Port Chester, Jamestown, Harrison, Newburgh, Saratoga Springs, Middletown,
Glen Cove, Elmira, Lindenhurst, Auburn, Kiryas Joel, Rockville Centre, Ossining, Peekskill, Watertown, Kingston,
Garden City, Lockport, Plattsburgh, Mamaroneck, Lynbrook, Mineola, Cortland, Scarsdale, Cohoes, Lackawanna, Amsterdam,
Massapequa Park, Oswego, Rye, Floral Park, Westbury, Depew, Kenmore, Gloversville, Tonawanda, Glens Falls,
Mastic Beach, Batavia, Johnson City, Oneonta, Beacon, Olean, Endicott, Geneva, Patchogue, Haverstraw, Babylon,
Tarrytown, Dunkirk, Mount Kisco, Dobbs Ferry, Lake Grove, Fulton, Oneida, Woodbury, Suffern, Corning, Fredonia,
Ogdensburg, West Haverstraw, Great Neck, Sleepy Hollow, Canandaigua, Lancaster, Massena, Watervliet, New Hyde Park,
East Rockaway, Potsdam, Amityville, Rye Brook, Hamburg, Farmingdale, Rensselaer, New Square, Airmont, Newark, Monroe,
Malverne, Port Jervis, Croton-on-Hudson, Johnstown, Brockport, Geneseo, Chestnut Ridge, Hornell, Briarcliff Manor,
Baldwinsville, Hastings-on-Hudson, Port Jefferson, Ilion, Colonie, Scotia, Herkimer, Williston Park, East Hills,
Northport, Great Neck Plaza, Pleasantville, Pelham, New Paltz, Nyack, Hudson Falls, Warwick, Bayville, Manorhaven,
Cedarhurst, Walden, Lawrence, North Hills, North Syracuse, Tuckahoe, Irvington, Norwich, East Rochester, Canton,
Bronxville, Monticello, Horseheads, Solvay, Larchmont, East Aurora, Hudson, Kaser, Wesley Hills, Albion,
New Hempstead, Hilton, Washingtonville, Elmsford, Medina, Webster, Malone, Fairport, Pelham Manor, Bath, Salamanca,
Wappingers Falls, Goshen, Kings Point, Saranac Lake, Williamsville, Ballston Spa, Sea Cliff, Waterloo, Island Park,
Mechanicville, Flower Hill, Penn Yan, Old Westbury, Chittenango, Ardsley, Little Falls, Montebello, Cobleskill,
Montgomery, Canastota, Dansville, Manlius, Wellsville, Springville, Chester, Le Roy, Hamilton, Alfred, Fayetteville,
Liberty, Waverly, Owego, Ellenville, Menands, Maybrook, Spencerport, Elmira Heights, Highland Falls, Saugerties
""".replace("\n", " ").split(",")
]

# Neighborhoods of New York City by borough.
NEIGHBORHOODS_BY_BOROUGH = {
    borough: [term.strip().lower() for term in terms.replace("\n", " ").split(",")]
    for borough, terms in {
        "brooklyn": """
Bath Beach, Bay Ridge, Bedford Stuyvesant, Bensonhurst, Bergen Beach, Boerum Hill, Borough Park, Brighton Beach,
Broadway Junction, Brooklyn Heights, Brownsville, Bushwick, Canarsie, Carroll Gardens, City Line, Clinton Hill,
Cobble Hill, Coney Island, Crown Heights, Cypress Hills, Ditmas Park, Downtown, DUMBO, Dyker Heights, East Flatbush,
East New York, East Williamsburg, Farragut, Flatbush, Flatlands, Fort Greene, Fort Hamilton, Fulton Ferry, Georgetown,
Gerritsen Beach, Gowanus, Gravesend, Greenpoint, Highland Park, Homecrest, Kensington, Kings Highway,
Manhattan Beach, Manhattan Terrace, Mapleton, Marine Park, Midwood, Mill Basin, Mill Island, Navy Yard, New Lots,
North Side, Ocean Hill, Ocean Parkway, Paerdegat Basin, Park Slope, Plum Beach, Prospect Heights,
Prospect Lefferts Gardens, Prospect Park South, Red Hook, Remsen Village, Rugby, Sea Gate, Sheepshead Bay, South Side,
Spring Creek, Starrett City, Stuyvesant Heights, Sunset Park, Tompkins Park North, Vinegar Hill, Weeksville,
West Brighton, Williamsburg, Windsor Terrace, Wingate
""",
        "bronx": """
Allerton, Bathgate, Baychester, Bedford Park, Belmont, Bronxdale, Bronx Park South, Bronx River, Castle Hill,
City Island, Claremont Village, Clason Point, Concourse, Concourse Village, Co-op City, Country Club, East Tremont,
Eastchester, Edenwald, Edgewater Park, Fieldston, Fordham, High Bridge, Hunts Point, Kingsbridge,
Kingsbridge Heights, Longwood, Marble Hill, Melrose, Morris Heights, Morris Park, Morrisania, Mott Haven, Mount Eden,
Mount Hope, North Riverdale, Norwood, Olinville, Parkchester, Pelham Bay, Pelham Gardens, Pelham Parkway,
Port Morris, Riverdale, Schuylerville, Soundview, Spuyten Duyvil, Throgs Neck, Unionport, University Heights,
Van Nest, Wakefield, West Farms, Westchester Square, Williamsbridge, Woodlawn
""",
        "manhattan": """
Battery Park City, Beekman Place, Carnegie Hill, Chelsea, Chinatown, Civic Center, Clinton, East Harlem,
East Village, Financial District, Flatiron, Gramercy, Greenwich Village, Hamilton Heights, Harlem (Central),
Herald Square, Hudson Square, Inwood, Lenox Hill, Lincoln Square, Little Italy, Lower East Side, Manhattan Valley,
Manhattanville, Midtown South, Midtown, Morningside Heights, Murray Hill, NoHo, Roosevelt Island, SoHo,
South Village, Stuyvesant Town, Sutton Place, Times Square, Tribeca, Tudor City, Turtle Bay, Union Square,
Upper East Side, Upper West Side, Wall Street, Washington Heights, West Village, Yorkville
""",
        "queens": """
Arverne, Astoria, Astoria Heights, Auburndale, Bay Terrace, Bayside, Bayswater, Beechhurst, Bellaire, Belle Harbor,
Bellerose, Blissville, Breezy Point, Briarwood, Broad Channel, Brookville, Cambria Heights, Clearview, College Point,
Douglaston, Dutch Kills, East Elmhurst, Edgemere, Elmhurst, Far Rockaway, Floral Park, Flushing,
Flushing (Downtown), Forest Hills, Forest Hills Gardens, Fresh Meadows, Glen Oaks, Glendale, Hammels, Hillcrest,
Hollis, Holliswood, Howard Beach, Hunters Point, Jackson Heights, Jamaica, Jamaica Center, Jamaica Estates,
Jamaica Hills, Kew Gardens, Kew Gardens Hills, Laurelton, Lefrak City, Lindenwood, Little Neck, Long Island City,
Malba, Maspeth, Middle Village, Murray Hill, Neponsit, New Hyde Park, North Corona, Oakland Gardens, Ozone Park,
Pomonok, Queens Village, Queensboro Hill, Ravenswood, Rego Park, Richmond Hill, Ridgewood, Rochdale, Rockaway Park,
Rosedale, Roxbury, Seaside, Somerville, South Corona, South Jamaica, South Ozone Park, Springfield Gardens,
St. Albans, Steinway, Sunnyside, Sunnyside Gardens, Utopia, Whitestone, Woodhaven, Woodside
""",
        "staten island": """
Annadale, Arden Heights, Arlington, Arrochar, Bay Terrace, Bloomfield, Bulls Head, Butler Manor, Castleton Corners,
Charleston, Chelsea, Clifton, Concord, Dongan Hills, Egbertville, Elm Park, Eltingville, Emerson Hill, Fox Hills,
Graniteville, Grant City, Grasmere, Great Kills, Greenridge, Grymes Hill, Heartland Village, Howland Hook, Huguenot,
Lighthouse Hill, Livingston, Manor Heights, Mariner's Harbor, Midland Beach, New Brighton, New Dorp, New Dorp Beach,
New Springville, Oakwood, Old Place, Old Town, Park Hill, Pleasant Plains, Port Ivory, Port Richmond, Prince's Bay,
Randall Manor, Richmond Town, Richmond Valley, Rosebank, Rossville, Sandy Ground, Shore Acres, Silver Lake,
South Beach, St. George, Stapleton, Sunnyside, Todt Hill, Tompkinsville, Tottenville, Travis, Ward Hill,
West Brighton, Westerleigh, Willowbrook, Woodrow
""",
    }.items()
}

# Boroughs and their letters.
BOROUGHS = "bronx, brooklyn, manhattan, queens, staten island".split(", ")
BOROUGH_LETTERS = "k m q r x".split()

# Words of a school name and of a school level.
SCHOOL_WORDS = "hs prep school academy college learning".split()
SCHOOL_LEVELS = "k-8 k-2 k-3 elementary middle transfer high d75 yabc".split()

# Colour codes and names.
COLOR_CODES = "bk bl bg br gl gy mr or pk pr rd tn wh yw".split()
COLORS = "black blue beige brown gold gray maroon orange pink purple red tan white yellow".split()

# Codes of car makes.
CAR_MAKES = """
acur alfa amgn amer asto audi aust avti autu bent bero blui bmw bric broc bsa buic cadi chec chev chry citr daew daih
dats delo deso diar dina divc dodg duca egil excl ferr fiat ford frht fwd gzl gmc grum hd hill hino hond huds hyun
infi intl isu ivec jagu jens kawk kw kia lada lamo lnci lndr lexs linc lotu mack mase mayb mazd mcin merz merc merk mg
mits morg morr mogu navi neop niss nort olds opel ontr oshk pack panz ptrb peug plym pont pors rela rena rol saa strn
scan sim sin stlg stu stuz suba sunb suzi thms toyt triu tvr ud vcty volk volv wstr whit whgm yama yugo
""".split()

# Codes of vehicle bodies.
VEHICLE_TYPES = """
fire conv sedn subn 4dsd 2dsd h/wh atv mcy h/in loco rplc ambu p/sh rbm r/rd rd/s s/sp sn/p trav mobl tr/e t/cr tr/c
swt w/dr w/sr fpm mcc emvr trac delv dump flat pick stak tank refg tow van util pole boat h/tr semi trlr ltrl lsvt bus
lim hrse taxi dcom cmix mopd mfh snow lsv
""".split()

# City agencies, by letters and by words.
AGENCY_CODES = """
311 acs bic boe bpl cchr ccrb cuny dca dcas dcla dcp ddc dep dfta dhs dob doc doe dof dohmh doi doitt dop dor dot dpr
dsny dvs dycd edc fdny hpd hra law lpc nycem nycha nypd nypl oath ocme qpl sbs sca tlc
""".split()
AGENCY_WORDS = "office dept city district president board comm department agency library".split()

# Areas of study.
STUDY_AREAS = """
architecture, science, art, teaching, business, communications, cosmetology, engineering, humanities, technology,
health, economics, environment, algebra, chemistry, english, math, social studies
""".replace("\n", " ").strip().split(", ")
STUDY_AREAS = [area.strip() for area in STUDY_AREAS]

# Words of a location type.
LOCATION_WORDS = """
building airport atm bank club bridge terminal store office station hospital residence restaurant tunnel park shelter
mailbox school street transit stop factory
""".split()

# Words of a park name and of a university name.
PARK_WORDS = "park playground garden".split()
UNIVERSITY_WORDS = ["university"]

# Street words; the last one counts for street names only.
ADDRESS_STREET_WORDS = """
street st avenue ave road rd highway hwy square sq trail trl drive dr court ct park parkway pkwy circle cir boulevard
blvd
""".split()
STREET_WORDS = ADDRESS_STREET_WORDS + ["place"]


def neighborhoods() -> list[str]:
    """Union of the borough lists, in order of first appearance."""
    return list(dict.fromkeys(t for terms in NEIGHBORHOODS_BY_BOROUGH.values() for t in terms))
