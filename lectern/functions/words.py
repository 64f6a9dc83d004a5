"""Fixed word lists that decide results."""

#: Words that a skill's description shares with any other.
STOP_WORDS = (
    "a about after against all also an and any are as at be been being both but by can code create creating do does "
    "doing each even every for from get gets has have how into is it its just like make makes making may more most must "
    "need needs not of on once one only or other out over same should skill so some such than that the their them "
    "then there these they this those through to too under up use used user uses using very want wants was were what when "
    "where which while who will with would you your"
).split()

#: Phrases that say when a skill is to be used.
TRIGGERS = (
    "use when", "use this when", "when the user", "when you", "when asked", "when working", "when building", "when creating",
    "when the task", "triggers when", "for when", "invoke when", "load when", "applies when", "should be used",
)
