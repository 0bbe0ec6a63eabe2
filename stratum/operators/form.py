"""Fixed values that must equal the reference's for identical results:
the questionnaire, its scaled-answer map, the reply texts and the phrase /
HMM tables.  Stated plainly, in natural order, as data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Questionnaire fields (id, type, options | (min, max)).
# ---------------------------------------------------------------------------
SCALE_0_5 = ["0 (None)", "1 (Minimal)", "2 (Mild)", "3 (Moderate)", "4 (Severe)", "5 (Extreme)"]

FORM = [
    {"id": "Age", "type": "number", "min": 18, "max": 35},
    {"id": "Course", "type": "select",
     "options": ["Computer Science", "Engineering", "Business", "Medical", "Law", "Others"]},
    {"id": "Gender", "type": "select", "options": ["Male", "Female"]},
    {"id": "CGPA", "type": "number", "min": 2.0, "max": 4.0},
    {"id": "Depression_Score", "type": "select", "options": SCALE_0_5},
    {"id": "Anxiety_Score", "type": "select", "options": SCALE_0_5},
    {"id": "Sleep_Quality", "type": "select", "options": ["Good", "Average", "Poor"]},
    {"id": "Physical_Activity", "type": "select", "options": ["High", "Moderate", "Low"]},
    {"id": "Diet_Quality", "type": "select", "options": ["Good", "Average", "Poor"]},
    {"id": "Social_Support", "type": "select", "options": ["High", "Moderate", "Low"]},
    {"id": "Relationship_Status", "type": "select", "options": ["Single", "In a Relationship", "Married"]},
    {"id": "Substance_Use", "type": "select", "options": ["Never", "Occasionally", "Frequently"]},
    {"id": "Counseling_Service_Use", "type": "select", "options": ["Never", "Occasionally", "Frequently"]},
    {"id": "Family_History", "type": "select", "options": ["Yes", "No"]},
    {"id": "Chronic_Illness", "type": "select", "options": ["Yes", "No"]},
    {"id": "Financial_Stress", "type": "select", "options": SCALE_0_5},
    {"id": "Extracurricular_Involvement", "type": "select", "options": ["High", "Moderate", "Low"]},
    {"id": "Semester_Credit_Load", "type": "number", "min": 15, "max": 29},
    {"id": "Residence_Type", "type": "select", "options": ["On-Campus", "Off-Campus", "With Family"]},
]
FORM_IDS = [f["id"] for f in FORM]
SCALED_FIELDS = ["Depression_Score", "Anxiety_Score", "Financial_Stress"]
NUMBER_FIELDS = ["Age", "CGPA", "Semester_Credit_Load"]

# ---------------------------------------------------------------------------
# Ordinal maps used by the notebook encodings.
# ---------------------------------------------------------------------------
ORDINAL_MAPS = {
    "Family_History": {"Yes": 1, "No": 0},
    "Chronic_Illness": {"Yes": 1, "No": 0},
    "Physical_Activity": {"Low": 1, "Moderate": 2, "High": 3},
    "Social_Support": {"Low": 1, "Moderate": 2, "High": 3},
    "Extracurricular_Involvement": {"Low": 1, "Moderate": 2, "High": 3},
    "Sleep_Quality": {"Poor": 1, "Average": 2, "Good": 3},
    "Diet_Quality": {"Poor": 1, "Average": 2, "Good": 3},
    "Substance_Use": {"Never": 0, "Occasionally": 1, "Frequently": 2},
    "Counseling_Service_Use": {"Never": 0, "Occasionally": 1, "Frequently": 2},
    "Gender": {"Male": 1, "Female": 0},
}
# Columns the notebook replaces by their relative frequency.
FREQUENCY_ENCODED = ["Course", "Relationship_Status", "Residence_Type"]

# ---------------------------------------------------------------------------
# Reply texts of the rule scorer.
# ---------------------------------------------------------------------------
BASE_RECS_LOW = [
    "Continue maintaining good sleep habits and physical activity",
    "Keep up your social connections and support systems",
    "Maintain your current study-life balance",
    "Consider seeking occasional check-ins with academic advisors",
]
BASE_RECS_ELEVATED = [
    "Consider speaking with a counselor at your university's mental health services",
    "Try to improve your sleep schedule and quality",
    "Increase your physical activity, even short walks can help",
    "Develop a study schedule that includes regular breaks",
    "Connect with peers or join study groups for social support",
    "Practice stress reduction techniques like deep breathing or meditation",
]
REC_POOR_SLEEP = "Prioritize improving your sleep by establishing a regular sleep schedule"
REC_LOW_ACTIVITY = "Try to incorporate more physical activity into your daily routine"
REC_LOW_SUPPORT = "Consider joining student groups or clubs to increase your social connections"
REC_FINANCIAL = "Look into financial aid resources or part-time work opportunities at your university"
FALLBACK_MESSAGE = "We encountered an issue processing your responses. Here are some general recommendations."
FALLBACK_RECS = [
    "Consider speaking with a counselor at your university's mental health services",
    "Maintain a healthy sleep schedule and regular physical activity",
    "Develop effective study habits and time management skills",
    "Stay connected with friends and family for social support",
]

# ---------------------------------------------------------------------------
# Phrase tables and HMM parameters of the response generator.
# ---------------------------------------------------------------------------
STATES = ["Low", "Moderate", "High"]
TRANSITIONS = {
    "Low": {"Low": 0.6, "Moderate": 0.3, "High": 0.1},
    "Moderate": {"Low": 0.3, "Moderate": 0.4, "High": 0.3},
    "High": {"Low": 0.1, "Moderate": 0.3, "High": 0.6},
}
OPENINGS = {
    "Low": ["You're managing stress well", "Great job maintaining balance", "Your approach is working effectively",
            "Keep up the good work", "You're on the right track"],
    "Moderate": ["Some stress is manageable", "Room for improvement", "You're handling things okay",
                 "Could use some adjustments", "Making progress"],
    "High": ["Significant stress detected", "Important to address this", "Consider seeking help",
             "Time to take action", "Focus on reducing stress"],
}
FACTOR_PHRASES = {
    "Sleep_Quality": {
        "Poor": ["Establish a regular sleep schedule", "Create a relaxing bedtime routine",
                 "Limit screen time before bed"],
        "Average": ["Maintain consistent sleep patterns", "Consider your sleep environment",
                    "Try to improve sleep quality"],
        "Good": ["Keep up your healthy sleep routine", "Maintain your current sleep habits",
                 "Your sleep quality is excellent"],
    },
    "Physical_Activity": {
        "Low": ["Incorporate more physical activity", "Start with short walks", "Try light exercise"],
        "Moderate": ["Maintain your activity level", "Add variety to your routine", "Keep up the good work"],
        "High": ["Excellent activity level", "Continue your exercise habits", "Your activity is ideal"],
    },
    "Social_Support": {
        "Low": ["Reach out to friends more often", "Build stronger connections", "Join a club or group"],
        "Moderate": ["Maintain current relationships", "Strengthen social connections",
                     "Expand your social circle"],
        "High": ["Great social support system", "Keep nurturing relationships", "Your connections are strong"],
    },
}
CLOSINGS = {
    "Low": "Keep up the good work and continue practicing these healthy habits!",
    "Moderate": "With some small changes, you can improve your stress management.",
    "High": "It's important to take action to reduce your stress levels. Consider seeking professional help if needed.",
}
UNKNOWN_EMISSION = 1e-10
